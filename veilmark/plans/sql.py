"""The derived tables in SQL for DuckDB, stated independently of the DataFrame code: positions as sets, rows as lists."""

from __future__ import annotations

from ..functions.texts import MONTHS, SHORT_MONTHS, WEEKDAYS
from ..operators.draws import MULTIPLIER, ROUNDS, STEP
from ..sources.derived import FIRST_NAMES, SURNAMES


def items(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


SPANS = """
d AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS document_id, CAST(length(text) AS BIGINT) AS n, lang, source FROM documents WHERE text IS NOT NULL),
s AS (SELECT *, i * 40 + (i * 7 + doc_id) % 13 AS b, 4 + i % 9 AS w,
        CASE i % 4 WHEN 0 THEN 'Name:Patient' WHEN 1 THEN 'Name:Caregiver' WHEN 2 THEN 'Date' ELSE 'Age_Birthdate' END AS lab
      FROM (SELECT d.*, unnest(range(0, n // 40)) AS i FROM d)),
gold AS (SELECT document_id, source, i, b AS "begin", b + w AS "end", lab AS label FROM s WHERE source <> 'src4' AND i % 5 <> 3
      UNION ALL SELECT document_id, source, i, b, b + w, lab FROM s WHERE source <> 'src4' AND i % 5 <> 3 AND i % 17 = 0
      UNION ALL SELECT document_id, source, i, b + 2, b + w + 6, 'Date' FROM s WHERE source <> 'src4' AND i % 11 = 4),
alpha_all AS (SELECT document_id, source, b AS "begin", b + w + CASE WHEN i % 5 = 1 THEN 1 ELSE 0 END AS "end", CASE WHEN i % 6 = 5 THEN 'Name:Other' ELSE lab END AS label FROM s WHERE source <> 'src3' AND i % 7 <> 2
      UNION ALL SELECT document_id, source, b + 1, b + 1, 'Date' FROM s WHERE source <> 'src3' AND i % 19 = 3
      UNION ALL SELECT document_id, source, b + w - 1, b + w + 9, 'ID:Patient' FROM s WHERE source <> 'src3' AND i % 13 = 6),
beta_all AS (SELECT document_id, source, b AS "begin", b + w + CASE WHEN i % 5 = 1 THEN 1 ELSE 0 END AS "end", CASE WHEN i % 4 = 3 THEN 'Name:Other' ELSE lab END AS label FROM s WHERE source <> 'src3' AND i % 5 <> 2
      UNION ALL SELECT document_id, source, b + 1, b + 1, 'Date' FROM s WHERE source <> 'src3' AND i % 19 = 3
      UNION ALL SELECT document_id, source, b + w - 1, b + w + 9, 'ID:Patient' FROM s WHERE source <> 'src3' AND i % 13 = 6),
docs AS (SELECT document_id, n AS size FROM d WHERE source <> 'src4'),
sub AS (SELECT document_id, source, label, "begin" AS b, "begin" + 2 AS e, 'given' AS c FROM gold
      UNION ALL SELECT document_id, source, label, "begin" + 2, "end", CASE WHEN i % 10 = 9 THEN '' WHEN i % 3 = 0 THEN 'family' WHEN i % 3 = 1 THEN 'formatting' ELSE ' Title ' END FROM gold),
core AS (SELECT document_id, CASE WHEN source = 'src5' THEN 'Unassigned' ELSE label END AS label, coalesce(nullif(trim(c), ''), 'uncategorized') AS category, b, e FROM sub
      WHERE lower(trim(c)) NOT IN ('additional_info', 'formatting', 'medical_info', 'time', 'title')),
gp AS (SELECT DISTINCT document_id, label, p FROM (SELECT document_id, label, unnest(range("begin", "end")) AS p FROM gold)),
g AS (SELECT DISTINCT document_id, p FROM gp),
cp AS (SELECT DISTINCT document_id, label, category, p FROM (SELECT document_id, label, category, unnest(range(b, e)) AS p FROM core))"""


def spans(system: str = "alpha") -> str:
    """A WITH clause with the predictions of one system as pred, pp (positions by label) and q (positions)."""
    return f"""WITH {SPANS},
pred AS (SELECT * FROM {system}_all WHERE source <> 'src4'),
pp AS (SELECT DISTINCT document_id, label, p FROM (SELECT document_id, label, unnest(range("begin", "end")) AS p FROM pred)),
q AS (SELECT DISTINCT document_id, p FROM pp)
"""


_CASED = "CASE WHEN k % 4 = 1 THEN upper(x) WHEN k % 4 = 2 THEN lower(x) ELSE x END"
_RUNS = "array_to_string(list_transform(regexp_extract_all(base, '[A-Za-z]+|[^A-Za-z]+'), lambda r: upper(r[1]) || lower(r[2:])), '')"
_FIRST_LETTER = "(lower(regexp_extract(base, '^([^A-Za-z]*)', 1)) || upper(substr(base, length(regexp_extract(base, '^([^A-Za-z]*)', 1)) + 1, 1)) || lower(substr(base, length(regexp_extract(base, '^([^A-Za-z]*)', 1)) + 2)))"


def drawn(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws(':', {', '.join(parts)})), 1, 8) AS BIGINT)"


def draws(seed: int, purpose: str, blocks: int, documents: str) -> str:
    """(document_id, place, word): two words of 32 bits for each block of a document's stream (Philox 2x32, 10 rounds)."""
    part = lambda at: f"CAST('0x' || substr(md5('{seed}:{purpose}:' || document_id), {at}, 8) AS UBIGINT)"
    rounds = f"SELECT document_id, block, CAST(block AS UBIGINT) AS a, lane AS b, key AS k FROM (SELECT document_id, {part(1)} AS key, {part(9)} AS lane FROM (SELECT DISTINCT document_id FROM {documents})), range({blocks}) r(block)"
    for _ in range(ROUNDS):
        rounds = f"SELECT document_id, block, xor(xor((a * {MULTIPLIER}::UBIGINT) >> 32, k), b) AS a, (a * {MULTIPLIER}::UBIGINT) & 4294967295::UBIGINT AS b, (k + {STEP}::UBIGINT) & 4294967295::UBIGINT AS k FROM ({rounds})"
    return f"SELECT document_id, 2 * block + half AS place, CAST(CASE half WHEN 0 THEN a ELSE b END AS BIGINT) AS word FROM ({rounds}), range(2) h(half)"


def _dates(date: str) -> dict[str, str]:
    d, m, y = f"CAST(day({date}) AS VARCHAR)", f"CAST(month({date}) AS VARCHAR)", f"CAST(year({date}) AS VARCHAR)"
    full, short, week = f"{items(MONTHS)}[month({date})]", f"{items(SHORT_MONTHS)}[month({date})]", f"{items(WEEKDAYS)}[dayofweek({date}) + 1]"
    return {
        "numeric_slash_long": f"strftime({date}, '%d/%m/%Y')",
        "numeric_dash_long": f"strftime({date}, '%d-%m-%Y')",
        "numeric_dot_long": f"{d} || '.' || {m} || '.' || {y}",
        "textual_full": f"{d} || ' ' || {full} || ' ' || {y}",
        "textual_abbr_dot": f"{d} || ' ' || {short} || '. ' || {y}",
        "textual_hyphen": f"{d} || '-' || {short} || '-' || {y}",
        "weekday_textual": f"{week} || ' ' || {d} || ' ' || {full} || ' ' || {y}",
        "numeric_slash_short": f"{d} || '/' || {m} || '/' || strftime({date}, '%y')",
    }


NOTES = f"""
raw AS (SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS document_id, o_orderpriority AS scope, o_orderdate AS dt, CAST(o_custkey % 90 + 1 AS VARCHAR) || ' jr' AS age,
        {items(FIRST_NAMES)}[o_custkey % {len(FIRST_NAMES)} + 1] AS f, {items(SURNAMES)}[(o_custkey // {len(FIRST_NAMES)}) % {len(SURNAMES)} + 1] AS l FROM orders),
named AS (SELECT *, CASE k % 7 WHEN 0 THEN f || ' ' || l WHEN 1 THEN l || ' ' || f WHEN 2 THEN f WHEN 3 THEN l WHEN 4 THEN l || ', ' || f WHEN 5 THEN substr(f, 1, 1) || '. ' || l ELSE 'dr. ' || f || ' ' || l END AS x,
        CASE k % 8 {' '.join(f'WHEN {i} THEN {sql}' for i, sql in enumerate(_dates('dt').values()))} END AS day FROM raw),
note AS (SELECT k, document_id, scope, dt, age, f, {_CASED.replace('x', 'l')} AS l, {_CASED} AS name, {_CASED.replace('x', "substr(f, 1, 1) || '.'")} AS ini, CASE WHEN k % 7 = 6 THEN {_CASED.replace('x', "'dr.'")} || ' ' ELSE '' END AS title, day,
        CASE k % 3 WHEN 0 THEN 'Name:Patient' WHEN 1 THEN 'Name:Caregiver' ELSE 'Name:Other' END AS label FROM named),
target AS (SELECT *, 'name' AS kind, CASE k % 3 WHEN 0 THEN 'patient' ELSE 'caregiver' END AS role, name AS base, 0 AS span_index FROM note WHERE k % 3 <> 2
        UNION ALL SELECT *, 'date', 'date', day, CASE WHEN k % 3 = 2 THEN 0 ELSE 1 END FROM note
        UNION ALL SELECT *, 'age', 'age', age, CASE WHEN k % 3 = 2 THEN 1 ELSE 2 END FROM note)"""


def variants(year_min: int, year_max: int, step: int, trials: int, seed: int) -> str:
    """A WITH clause whose relation v has a row for each variant."""
    both, has_first = "k % 7 IN (0, 1, 4, 6)", "k % 7 NOT IN (3, 5)"
    names = [
        ("capitalization", "full", _RUNS, "true"),
        ("capitalization", "first_only", _FIRST_LETTER, "true"),
        ("capitalization", "lower", "lower(base)", "true"),
        ("capitalization", "upper", "upper(base)", "true"),
        ("format", "full_name", "f || ' ' || l", both),
        ("format", "first_only", "f", has_first),
        ("format", "initials_only", "substr(f, 1, 1) || '.' || upper(substr(l, 1, 1)) || '.'", both),
        ("format", "first_initials", "f || ' ' || upper(substr(l, 1, 1)) || '.'", both),
        ("format", "title_dr", "'dr. ' || CASE WHEN k % 7 IN (3, 5) THEN l WHEN k % 7 = 2 THEN f ELSE f || ' ' || l END", "true"),
    ]
    def pick(kind: str, values: list[str], original: str | None = None) -> str:
        n = drawn(str(seed), "document_id", "span_index", "t", f"'{kind}'")
        if not original:
            return f"{items(values)}[{n} % {len(values)} + 1]"
        return f"list_filter({items(values)}, lambda x: lower(x) <> lower({original}))[{n} % {len(values) - 1} + 1]"

    ages = ["%s jaar", "%s j.", "%s jr.", "%s-jarige", "%s jaar oud", "%sj"]
    rows = [f"SELECT *, '{d}' AS dimension, '{v}' AS value, {r} AS repl, {i} AS ord, 'w' AS grp FROM target WHERE kind = 'name' AND {c}" for i, (d, v, r, c) in enumerate(names)]
    rows += [f"SELECT *, 'date_format', '{p}', {sql}, {i}, 'f' FROM target WHERE kind = 'date'" for i, (p, sql) in enumerate(_dates("dt").items())]
    rows += [f"SELECT *, 'age_format', 'age_{i}', replace('{a}', '%s', regexp_extract(base, '[0-9]+')), {i}, 'f' FROM target WHERE kind = 'age'" for i, a in enumerate(ages)]
    style = "CASE WHEN k % 4 = 1 THEN upper(x) WHEN k % 4 = 2 THEN lower(x) ELSE x END"
    first, last, ini = style.replace("x", "nf"), style.replace("x", "nl"), style.replace("x", "substr(nf, 1, 1) || '.'")
    form = f"title || CASE k % 7 WHEN 1 THEN {last} || ' ' || {first} WHEN 2 THEN {first} WHEN 3 THEN {last} WHEN 4 THEN {last} || ', ' || {first} WHEN 5 THEN {ini} || ' ' || {last} ELSE {first} || ' ' || {last} END"
    return f"""WITH {NOTES},
tries AS (SELECT *, CASE WHEN k % 7 = 2 THEN {pick('f', FIRST_NAMES, 'f')} ELSE {pick('f', FIRST_NAMES)} END AS nf FROM (SELECT target.*, t FROM target, range(0, {trials}) AS x(t) WHERE kind = 'name')),
other AS (SELECT *, CASE WHEN k % 7 IN (3, 5) OR lower(nf) = lower(f) THEN {pick('l', SURNAMES, 'l')} ELSE {pick('l', SURNAMES)} END AS nl FROM tries),
opt AS ({' UNION ALL '.join(rows)}
  UNION ALL SELECT * EXCLUDE (t, nf, nl), 'name_source', 'other_' || t, {form}, CAST(t AS INTEGER), 'o' FROM other),
kept AS (SELECT * FROM opt WHERE repl <> base QUALIFY row_number() OVER (PARTITION BY document_id, span_index, grp, repl ORDER BY ord) = 1),
shift AS (SELECT target.*, 'date_value_shift' AS dimension, CAST(y AS VARCHAR) AS value, replace(base, CAST(year(dt) AS VARCHAR), CAST(y AS VARCHAR)) AS repl FROM target, range({year_min}, {year_max + 1}, {step}) AS r(y)
  WHERE kind = 'date' AND contains(base, CAST(year(dt) AS VARCHAR)) AND y <> year(dt)),
every AS (SELECT *, 'baseline' AS dimension, 'original' AS value, base AS repl FROM target UNION ALL SELECT * EXCLUDE (ord, grp) FROM kept UNION ALL SELECT * FROM shift),
v AS (SELECT *, document_id || '::' || span_index || '::' || dimension || '::' || value AS variant_id FROM every)
"""
