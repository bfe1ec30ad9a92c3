"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

from tablewright.llm import language, urls


def crc32(text: str) -> str:
    """Unsigned CRC-32 of the UTF-8 bytes of a text, bit by bit."""
    octets = f"list_transform(range(1, 2 * octet_length(encode({text})) + 1, 2), lambda i: concat('0x', substr(hex(encode({text})), i, 2))::BIGINT)"
    byte = "list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda a, b: {byte}), 4294967295)"


LANGUAGE = rf"""
WITH src AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce({crc32("cast(doc_id AS VARCHAR)")}, 0) % {language.FOLDS} = {language.HELD} AS held_out,
    trim(regexp_replace(lower(coalesce(text, '')), '[^\p{{L}}]+', ' ', 'g')) AS t FROM documents),
words AS (SELECT rid, unnest(string_split(t, ' ')) AS w FROM src WHERE t <> ''),
grams AS (
  SELECT rid, unnest(list_concat(list_transform(range(1, length(w) + 1), lambda i: substr(w, i, 1)), list_transform(range(1, length(w) + 2), lambda i: substr(concat(' ', w, ' '), i, 2)),
    list_transform(range(1, length(w) + 1), lambda i: substr(concat(' ', w, ' '), i, 3)))) AS g FROM words),
counts AS (SELECT rid, g, count(*) AS n FROM grams GROUP BY ALL),
own AS (SELECT rid, g, row_number() OVER (PARTITION BY rid ORDER BY n DESC, length(g), g) - 1 AS r FROM counts QUALIFY r < {language.PROFILE}),
totals AS (SELECT lang, g, sum(n) AS n FROM counts JOIN src USING (rid) WHERE lang IS NOT NULL AND NOT held_out GROUP BY ALL),
profiles AS (SELECT lang, g, row_number() OVER (PARTITION BY lang ORDER BY n DESC, length(g), g) - 1 AS r FROM totals QUALIFY r < {language.PROFILE}),
apart AS (
  SELECT rid, l.lang, sum(CASE WHEN p.r IS NULL THEN {language.PROFILE} ELSE abs(p.r - own.r) END)::DOUBLE / ({language.PROFILE} * count(*)) AS d
  FROM own CROSS JOIN (SELECT DISTINCT lang FROM profiles) AS l LEFT JOIN profiles AS p ON p.lang = l.lang AND p.g = own.g GROUP BY ALL),
best AS (SELECT rid, list(struct_pack(d := d, lang := lang) ORDER BY d, lang) AS b FROM apart GROUP BY rid)
SELECT doc_id, held_out, coalesce(b[1].lang, 'und') AS lang_pred,
  CASE WHEN b IS NULL THEN 0.0 WHEN len(b) = 1 THEN 1.0 WHEN b[2].d = 0 THEN 0.5 ELSE b[2].d / (b[1].d + b[2].d) END::DOUBLE AS score
FROM src LEFT JOIN best USING (rid)"""


def _url_sql() -> str:
    fits = {t: f"(host = '{t[:t.index('/')]}' OR ends_with(host, '.{t[:t.index('/')]}')) AND starts_with(path, '{t[t.index('/'):]}')" for t, _ in urls.RULES}
    longest = sorted(urls.RULES, key=lambda r: -len(r[0]))
    cases = {k: "CASE " + " ".join(f"WHEN {fits[r[0]]} THEN '{r[k]}'" for r in longest) + " END" for k in (0, 1)}
    n, step = urls.SYMBOLS, []
    for o in range(1, urls.ORDER + 1):  # interpolate one order after the other
        low = f"q{o - 1}"
        p = ", ".join(f"CASE WHEN coalesce(n{c}, 0) + coalesce(t{c}, 0) > 0 THEN (coalesce(s.{c}, 0) + coalesce(t{c}, 0) * {low}.p{c}) / (coalesce(n{c}, 0) + coalesce(t{c}, 0))::DOUBLE ELSE {low}.p{c} END AS p{c}"
                      for c in "ab")
        step.append(f"""s{o} AS (SELECT m, cell % {n**o} AS place, sum(a) AS a, sum(b) AS b FROM counts GROUP BY ALL),
c{o} AS (SELECT m, place // {n} AS context, sum(a) AS na, sum(b) AS nb, count_if(a > 0) AS ta, count_if(b > 0) AS tb FROM s{o} GROUP BY ALL),
q{o} AS (SELECT {low}.m, {low}.cell, {p} FROM {low} LEFT JOIN s{o} AS s ON s.m = {low}.m AND s.place = {low}.cell % {n**o}
  LEFT JOIN c{o} AS c ON c.m = {low}.m AND c.context = ({low}.cell % {n**o}) // {n})""")
    return f"""
WITH rest AS (SELECT row_number() OVER () AS rid, page_id, url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parts AS (SELECT rid, page_id, coalesce(url, '') AS url, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM rest),
marked AS (SELECT *, {cases[0]} AS rule, {cases[1]} AS ruled, {crc32("url")} % {urls.FOLDS} = 0 AS held,
  list_concat([0, 0, 0], list_transform(list_filter(string_split(regexp_replace(translate(url, '{urls.UPPER}', '{urls.LOWER}'), '[0-9]', '0', 'g'), ''), lambda x: x <> ''), lambda x: strpos('{urls.ALPHABET}', x))) AS c FROM parts),
cells AS (SELECT rid, unnest(list_transform(range(4, len(c) + 1), lambda i: c[i] + {n} * c[i - 1] + {n**2} * c[i - 2] + {n**3} * c[i - 3])) AS cell FROM marked),
known AS (SELECT 0 AS m, rid, ruled FROM marked WHERE ruled IS NOT NULL AND NOT held UNION ALL SELECT 1, rid, ruled FROM marked WHERE ruled IS NOT NULL),
counts AS (SELECT m, cell, count_if(ruled = 'allow') AS a, count_if(ruled = 'block') AS b FROM known JOIN cells USING (rid) GROUP BY ALL),
q0 AS (SELECT m, cell, 1.0::DOUBLE / {n} AS pa, 1.0::DOUBLE / {n} AS pb FROM (SELECT DISTINCT cell FROM cells), (SELECT unnest([0, 1]) AS m)),
{", ".join(step)},
scores AS (SELECT m, rid, sum(ln(pa) - ln(pb)) / count(*) AS score FROM cells JOIN q{urls.ORDER} USING (cell) GROUP BY ALL),
bins AS (SELECT floor(coalesce(score, 0) * {urls.BINS_PER_UNIT}) AS bin, count_if(ruled = 'allow') AS p, count_if(ruled = 'block') AS n
  FROM marked LEFT JOIN scores AS s ON s.rid = marked.rid AND s.m = 0 WHERE ruled IS NOT NULL AND held GROUP BY ALL),
rated AS (SELECT bin, sum(p) OVER w / sum(p) OVER () + 1 - sum(n) OVER w / sum(n) OVER () AS value, sum(p) OVER () AS all_p, sum(n) OVER () AS all_n FROM bins WINDOW w AS (ORDER BY bin DESC)),
cut AS (SELECT coalesce((SELECT bin / {urls.BINS_PER_UNIT} FROM rated WHERE all_p > 0 AND all_n > 0 ORDER BY value DESC, bin LIMIT 1), 0.0) AS cut)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN coalesce(score, 0) >= cut THEN 'allow' ELSE 'block' END) AS verdict, round(coalesce(score, 0), 6) AS score
FROM marked CROSS JOIN cut LEFT JOIN scores AS s ON s.rid = marked.rid AND s.m = 1"""


URLS = _url_sql()
