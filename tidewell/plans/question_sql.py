"""SQL of the date phrases of questions."""

from __future__ import annotations

from ..operators import questions

NUMBER = "CASE lower(regexp_extract(p, '{a}', 1)) {w} ELSE try_cast(regexp_extract(p, '{a}', 1) AS INT) END".format(a=questions.AGO, w=" ".join(f"WHEN '{k}' THEN {v}" for k, v in questions.NUMBERS.items()))
UNIT = f"lower(regexp_extract(p, '{questions.AGO}', 2))"
AGO_SQL = f"list_transform(regexp_extract_all(question, '{questions.AGO}'), lambda p: CASE WHEN starts_with({UNIT}, 'day') THEN day - {NUMBER} WHEN starts_with({UNIT}, 'week') THEN day - 7 * {NUMBER} ELSE CAST(day - to_months({NUMBER}) AS DATE) END)"
LAST = "list_position({}, lower(regexp_extract(question, '(?i)\\blast\\s+({})\\b', 1)))".format(questions.WEEKDAYS, "|".join(questions.WEEKDAYS))
HINTS = f"""list_sort(list_distinct(list_filter(list_concat({AGO_SQL}, [CASE WHEN regexp_matches(question, '(?i)\\btoday\\b') THEN day END, CASE WHEN regexp_matches(question, '(?i)\\byesterday\\b') THEN day - 1 END,
  CASE WHEN regexp_matches(question, '(?i)\\blast\\s+week\\b') THEN day - 7 END, CASE WHEN {LAST} > 0 THEN day - CAST((isodow(day) - 1 - ({LAST} - 1) + 6 + 7) % 7 + 1 AS INT) END]), lambda x: x IS NOT NULL)))"""
