"""DuckDB SQL for those queries of the corpus operators that SQL expresses."""

from genospark.llm.quality import MEASURES

_LIST = ", ".join(f"'{m}'" for m in MEASURES)
_SPREAD = "CASE measure " + " ".join(f"WHEN '{m}' THEN {v}" for m, v in MEASURES.items()) + " END"
_TOP = "CASE WHEN {0} < 64 THEN {0} ELSE (({0} - 32 * ({0} // 32 - 1) + 1) << ({0} // 32 - 1)) - 1 END"


def _fences(name: str, sketch: str, by: str) -> str:
    group, comma = (by, f"{by}, ") if by else ("", "")
    part = f"PARTITION BY {comma}measure"
    picks = ", ".join(f"max(CASE WHEN measure = '{m}' THEN {x} END) AS {x}_{m}" for m in MEASURES for x in ("lo", "hi"))
    return f"""
    {name}_c AS (SELECT *, sum(n) OVER ({part} ORDER BY bucket) AS c, sum(n) OVER ({part}) AS t FROM {sketch}),
    {name}_q AS (SELECT {comma}measure, max(t) AS docs, min(CASE WHEN 4 * c >= t THEN bucket END) AS b1, min(CASE WHEN 4 * c >= 3 * t THEN bucket END) AS b3
        FROM {name}_c GROUP BY {comma}measure),
    {name}_v AS (SELECT *, {_TOP.format('b1')} AS q1, {_TOP.format('b3')} AS q3 FROM {name}_q),
    {name}_l AS (SELECT *, q1 - 3 * greatest(q3 - q1, {_SPREAD}) AS lo, q3 + 3 * greatest(q3 - q1, {_SPREAD}) AS hi FROM {name}_v),
    {name} AS (SELECT {comma}max(docs) AS docs, {picks} FROM {name}_l {'GROUP BY ' + group if by else ''})"""


def quality(table: str = "documents") -> str:
    """The common table expressions that end in judged: all columns of the table and the results."""
    pick = ", ".join(f"CASE WHEN a.docs >= 50 THEN a.{x}_{m} WHEN b.docs >= 50 THEN b.{x}_{m} ELSE c.{x}_{m} END AS {x}_{m}" for m in MEASURES for x in ("lo", "hi"))
    inside = " AND ".join(f"{m} BETWEEN lo_{m} AND hi_{m}" for m in MEASURES)
    return rf"""
    d AS (SELECT *, row_number() OVER () AS rid, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
            list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM {table}),
    win AS (SELECT rid, unnest(range(1, len(w) - 6)) AS i, w FROM d WHERE len(w) > 8),
    win2 AS (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS h FROM win),
    dup AS (SELECT rid, i FROM win2 QUALIFY count(*) OVER (PARTITION BY rid, h) > 1),
    cov AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM dup) GROUP BY rid),
    cnt AS (SELECT d.* EXCLUDE (w, l), CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
            CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
            CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines
        FROM d LEFT JOIN cov USING (rid)),
    mea AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, word_chars * 100 // greatest(n_words, 1) AS word_len,
            n_symbols * 1000 // greatest(n_words, 1) AS symbols, n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_lines,
            n_repeat_words * 1000 // greatest(n_words, 1) AS repeats FROM cnt),
    val AS (SELECT lang, source, unnest([{_LIST}]) AS measure, unnest([{', '.join(MEASURES)}]) AS v FROM mea WHERE NOT base_failed),
    fine AS (SELECT lang, source, measure, CASE WHEN v < 64 THEN v ELSE 32 * (length(bin(v)) - 6) + (v >> (length(bin(v)) - 6)) END AS bucket, count(*) AS n
        FROM val GROUP BY ALL),
    mid AS (SELECT lang, measure, bucket, sum(n) AS n FROM fine GROUP BY ALL),
    top AS (SELECT measure, bucket, sum(n) AS n FROM fine GROUP BY ALL),
    {_fences('fa', 'fine', 'lang, source')}, {_fences('fb', 'mid', 'lang')}, {_fences('fc', 'top', '')},
    grp AS (SELECT DISTINCT lang, source FROM mea),
    lim AS (SELECT g.lang AS lim_lang, g.source AS lim_source, {pick} FROM grp g
        LEFT JOIN fa a ON g.lang IS NOT DISTINCT FROM a.lang AND g.source IS NOT DISTINCT FROM a.source
        LEFT JOIN fb b ON g.lang IS NOT DISTINCT FROM b.lang LEFT JOIN fc c ON true),
    judged AS (SELECT mea.*, NOT base_failed AND coalesce({inside}, true) AS kept FROM mea
        LEFT JOIN lim ON lang IS NOT DISTINCT FROM lim_lang AND source IS NOT DISTINCT FROM lim_source)"""


QUALITY = f"WITH {quality()} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, {', '.join(MEASURES)} FROM judged"

MIXING = r"""
WITH d AS (SELECT doc_id, source, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, coalesce(text, '') AS x FROM documents),
rw AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' END || coalesce(source, '') AS s, CAST(len(w) AS BIGINT) AS size,
        -ln((CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || x), 1, 12) AS BIGINT) + 1) / CAST(281474976710657 AS DOUBLE))
        / greatest(len(list_distinct(w)) / greatest(len(w), 1), 0.05) AS k FROM d),
ss AS (SELECT s, CAST(sum(size) AS BIGINT) AS source_size FROM rw GROUP BY s),
r AS (SELECT *, (row_number() OVER (ORDER BY s) - 1) % 3 + 1 AS wt FROM ss),
l AS (SELECT *, source_size * 3 / wt AS level FROM r),
f AS (SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY level, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / (sum(wt) OVER () - coalesce(sum(wt) OVER (ORDER BY level, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lft FROM l),
g AS (SELECT (SELECT lft FROM f WHERE lft <= level ORDER BY level, s LIMIT 1) AS share),
t AS (SELECT s, source_size, CAST(CASE WHEN share IS NULL OR level < share THEN 3 * source_size ELSE share * wt END AS DOUBLE) AS target FROM f, g),
o AS (SELECT rw.*, source_size, target, CASE WHEN source_size = 0 THEN 0 ELSE least(floor(target / source_size), 3) END AS epochs,
        sum(size) OVER (PARTITION BY s ORDER BY k, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM rw JOIN t USING (s))
SELECT doc_id, size, source_size, target,
    CAST(size * (epochs + CASE WHEN epochs < 3 AND size > 0 AND upto - size / 2 <= target - epochs * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM o
"""

COLLOCATIONS = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, regexp_extract_all(unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w FROM d),
i AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p WHERE len(w) > 0),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM i, (SELECT unnest([1, 2, 3]) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 10),
u AS (SELECT lang, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3),
o AS (SELECT lang, phrase, max(a) AS longer FROM u GROUP BY ALL),
s AS (SELECT c.lang, c.phrase, a, w, unnest(range(1, k)) AS cut FROM c LEFT JOIN o ON c.lang = o.lang AND c.phrase = o.phrase WHERE k = 3 OR longer IS NULL OR 100 * longer < 50 * a),
t AS (SELECT s.lang, s.phrase, a, cut, x.f AS l, y.f AS r, CAST((1000000 * CAST(a AS HUGEINT) * a) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
    FROM s JOIN f x ON x.lang = s.lang AND x.phrase = array_to_string(w[1:cut], ' ') JOIN f y ON y.lang = s.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')),
b AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b)
SELECT lang, rank, phrase, a, l, r, n, score FROM r JOIN n USING (lang) WHERE rank <= 2000
"""

AUDIT = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
m AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
x AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
        CAST(len(w) < 200 AS INT) + 2 * CAST(100 * len(list_distinct(w)) < 50 * len(w) AS INT)
        + 4 * CAST(100 * length(regexp_replace(d.t, '[^A-Z]', '', 'g')) > 2 * length(d.t) AS INT) + 8 * CAST(regexp_matches(d.t, '[#$%&*|]') AS INT)
        + 16 * CAST(coalesce(d.doc_id > first, false) AS INT) AS fails
    FROM d JOIN m ON d.t = m.t LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM x GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f, unnest([1, 2, 4, 8, 16]) AS b),
p AS (SELECT f1.f || f2.f || f3.f || f4.f || f5.f AS o, [f1.b, f2.b, f3.b, f4.b, f5.b] AS bs FROM f f1, f f2, f f3, f f4, f f5
    WHERE f1.b + f2.b + f3.b + f4.b + f5.b = 31 AND len(list_distinct([f1.b, f2.b, f3.b, f4.b, f5.b])) = 5),
s AS (SELECT o, k AS step, bs[k] AS b, CAST(coalesce(list_sum(bs[1:k - 1]), 0) AS INT) AS before FROM p, (SELECT unnest([1, 2, 3, 4, 5]) AS k)),
e AS (SELECT DISTINCT b, before FROM s),
v AS (SELECT part, b, before, sum(CASE WHEN fails & (before | b) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN fails & before = 0 AND fails & b > 0 THEN n ELSE 0 END) AS removed,
        sum(CASE WHEN fails & before > 0 AND fails & b > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = b THEN n ELSE 0 END) AS unique_fails,
        sum(CASE WHEN fails & before = 0 AND fails & b > 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN fails & before = 0 AND fails & b > 0 THEN toxic ELSE 0 END) AS toxic_lost
    FROM c, e GROUP BY ALL),
h AS (SELECT part, b, sum(removed) AS shapley FROM s JOIN v USING (b, before) GROUP BY ALL)
SELECT part, o AS filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
    CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(shapley AS BIGINT) AS shapley
FROM s JOIN v USING (b, before) JOIN h USING (part, b)
"""
