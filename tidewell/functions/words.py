"""Word lists of the rules over questions, notes and states, one for each use."""

from __future__ import annotations

# All lists of this module.

#: Words that a query drops, English and Dutch.
STOP_EN = """a about above across actually after again against all along am among an and any are around at be because becoming been before behind being below beside between beyond bit but by can combined could
    detail details did do does doing down during each every find for from get give had has have having he her hers him his how i idea ideas if im in information inside into is it items its ive keep keeping kind kinds
    lately like list look looking make making many may me might mine must my near need needs no none nor of off on onto or our ours out over past planning please really recent recently recommend recommendation
    recommendations record records regarding relationship relationships seen shall she should show so some suggest suggestion suggestions sure tell than thanks that the their theirs them these they thinking this
    those through tip tips to tonight toward towards trouble type types under until up upcoming upon us useful was watch we were what when where which who whom whose why will with within without would yet you your
    yours""".split()
STOP_NL = """aan alleen als ben bent bij binnen boven buiten dan dat de deze die dit doen doet door een elk elke en geen haar hadden hebben heeft hem hen het hij hoe hun iedere ik ja je jij jouw jullie kan kunnen maar met
    mij mijn moet moeten na naar nee niet omdat onder ons onze ook op tegen toch tussen uit van veel voor waar waarom wanneer want waren wat weinig welk welke wie wij word worden wordt zal zich zij zijn zou""".split()
#: Words that a second search drops.
RETRY_STOP = """the a an and or but is are was what who when where why how you for from about advice any been can choose current decide deciding feeling find getting help helpful idea ideas interesting ive look looking
    make making might need needs noticed planning recent recently recommend recommendation recommendations should some soon suggest suggestion suggestions sure thinking tips together trying upcoming useful want
    weekend with would again becoming bit combined having items keep keeping kind kinds lately many seen show tonight trouble type types watch have has had de het een en of""".split()
#: Words of a question that are no tokens of it.
QUESTION_STOP = "the and for with what who when where why how did does was were are you your about this that have has had from into than then them they their".split()
#: Words that join two phrases, and words that end one.
CONNECTORS = "and or plus".split()
BOUNDARY = """a an the and or plus for with what who when where why how did does do was were is are am you your about this that these those have has had from into than then them they their i me my we our us it if to of on
    in at by amount total all list finally decided decide wondering wonder remembered remember thinking back previous conversation can could would should remind follow specific exact different type types spent spend
    bought buy ordered order purchased purchase paid pay submitted submit many much long last today yesterday tomorrow week month year monday tuesday wednesday thursday friday saturday sunday""".split()
TRIMMED = "many much long".split()
LOW_SIGNAL = "after before day days event events first happen happened month months second third time times week weeks year years".split()
#: Words that make no facet, and words that join capitalised ones.
FACET_SKIP = "amount current currently different day days event events exact first many much number previous pass passed recent same specific total type types".split()
GLUE = "of the".split()
#: Words that end a span of an event in questions about days.
DAY_BOUNDARY = "when while after before between and then ago days day".split()
COUNT_SKIP = "completed including number piece pieces".split()
#: Last words that keep the word before them.
HEADS = "development item items language languages product products".split()
ACTION_SKIP = "accept accepted acceptance begin began book booked booking buy bought complete completed completion date finish finished join joined order ordered purchase purchased start started submit submitted submission".split()
INSPIRED = "inspiration inspired ideas stuck uninspired".split()
INSPIRED_SKIP = "find finding fresh idea ideas inspiration inspired new stuck uninspired".split()
#: Words that are no focus of evidence.
EVIDENCE_STOP = """a about all also am an and are as at be been by count current currently date did do does for from had has have how i in is it me my of on overall recap same session so summary that the this to total was
    were what with spent spend paid pay bought buy purchased purchase ordered order donated donate raised raise earned earn sold sale completed finished attended visited""".split()
#: Words that say nothing of a state.
STATE_STOP = "about and are current currently does have how many now own owns still that the these what where which with".split()
#: Words that recall drops after stemming.
RECALL_STOP = """a an and are as at be been but by did do does for from had has have how i if in into is it its me my of on or our that the their them then there these they this those to was we were what when where which who
    with you your not""".split()
