import pytest

from tidewell.llm import html_text as H

TEXTS = {
    "it": "Il treno per la valle parte ogni mattina dalla stazione vecchia e arriva poco prima di mezzogiorno, quando i mercati stanno per chiudere e le strade tornano tranquille. ",
    "pl": "Pociąg do doliny odjeżdża każdego ranka ze starego dworca i przyjeżdża tuż przed południem, kiedy targi już się zamykają, a ulice znowu stają się ciche. ",
    "zh": "开往山谷的火车每天早晨从老车站出发，中午之前到达，那时集市快要关门，街道又安静下来。人们慢慢走回家，孩子们在河边玩耍，直到太阳落山为止。老人们坐在门前谈论天气和收成。",
    "ru": "Поезд в долину отправляется каждое утро со старого вокзала и приходит незадолго до полудня, когда рынки уже закрываются, а улицы снова становятся тихими. ",
}


@pytest.mark.parametrize("lang", TEXTS)
def test_pages_without_article_in_other_languages(lang):
    text = (TEXTS[lang] * 2).strip()
    links = "".join(f"<a href={i}>{TEXTS[lang][:40]}</a> " for i in range(9))
    page = f"<html lang={lang}><body><div>{links}</div><nav><p>{text}</p></nav><h2>{TEXTS[lang][:12]}</h2><p>{text}</p><p>{text}</p><div>{links}</div></body></html>"
    assert H.main_text(page) == "\n".join([TEXTS[lang][:12].strip(), text, text])
