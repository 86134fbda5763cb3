"""The registered queries of the training-data operators; each applies its operator to the whole of its table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import fingerprint, importance, langid, media, merkle, mixing, pack, quality, secrets, simhash, substring_dedup, suffix_dedup, urls
from .common import table


def op1_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_edits(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.find_secrets(table(spark, sf_dir, "documents")))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_round_trip(table(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: The rules of the registered query: host, path, verdict.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("print")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), RULES)


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(substring_dedup.repeated_passages(table(spark, sf_dir, "documents")))


def op9_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(suffix_dedup.later_copies(table(spark, sf_dir, "documents")))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(merkle.manifest(table(spark, sf_dir, "documents")))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("n_words")


def op13_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_fingerprint, op2_secrets, op3_mixing, op4_substring, op5_media, op6_urls, op7_packing, op8_quality, op9_suffix, op10_simhash, op11_manifest, op12_resample, op13_langid)}


_HOST_PATH = """SELECT *, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM (SELECT *, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM {0})"""

#: The same rows in SQL: rules by their length, and reachability over canonical and refresh edges by recursion.
OP6_SQL = f"""WITH RECURSIVE rules(rule_host, rule_path, say) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
tags AS (SELECT url, unnest(list_concat(
    list_transform(list_filter(regexp_extract_all(html, '(?i)<link\\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\\brel\\s*=\\s*["'']?\\s*canonical\\b')), lambda t: regexp_extract(t, '(?i)\\bhref\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1)),
    list_transform(list_filter(regexp_extract_all(html, '(?i)<meta\\b[^>]*>'), lambda t: regexp_matches(t, '(?i)\\bhttp-equiv\\s*=\\s*["'']?\\s*refresh\\b')), lambda t: regexp_extract(t, '(?i)\\burl\\s*=\\s*["'']?\\s*([^"''\\s>]+)', 1)))) AS href
  FROM pages WHERE contains(url, '://')),
based AS ({_HOST_PATH.format("tags")}),
edges AS (SELECT url AS u, CASE WHEN contains(href, '://') THEN href WHEN starts_with(href, '//') THEN scheme || ':' || href WHEN starts_with(href, '/') THEN scheme || '://' || host || href
    ELSE scheme || '://' || host || CASE WHEN folder = '' THEN '/' ELSE folder END || href END AS v
  FROM (SELECT *, substr(url, 1, strpos(url, '://') - 1) AS scheme, regexp_replace(path, '[^/]*$', '') AS folder FROM based WHERE href <> '')),
near AS (SELECT u, v FROM edges UNION SELECT v, u FROM edges),
reach(a, b) AS (SELECT u, v FROM near UNION SELECT r.a, n.v FROM reach r JOIN near n ON r.b = n.u),
urls AS (SELECT DISTINCT url FROM (SELECT url FROM pages UNION ALL SELECT a FROM reach) WHERE url IS NOT NULL),
parts AS ({_HOST_PATH.format("urls")}),
fits AS (SELECT url, rule_host || rule_path AS rule, say, row_number() OVER (PARTITION BY url ORDER BY length(rule_host || rule_path) DESC) AS rn
  FROM parts JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
best AS (SELECT url, rule, say FROM fits WHERE rn = 1),
handed AS (SELECT r.a AS url, bool_or(b.say = 'allow') AS allowed, bool_or(b.say = 'block') AS blocked FROM reach r JOIN best b ON r.b = b.url GROUP BY r.a)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.say, CASE WHEN h.blocked AND NOT h.allowed THEN 'block' END, 'allow') AS verdict
FROM ({_HOST_PATH.format("pages")}) p LEFT JOIN best b ON p.url = b.url LEFT JOIN handed h ON p.url = h.url"""


#: The digest of every window of 35 words, those that stand more than once, and the words that they cover.
OP4_SQL = """WITH w AS (SELECT row_number() OVER () AS row_, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
starts AS (SELECT row_, k, md5_number(array_to_string(ws[k:k + 34], ' ')) AS m FROM (SELECT row_, ws, unnest(range(1, len(ws) - 33)) AS k FROM w WHERE len(ws) >= 35)),
windows AS (SELECT row_, k, count(*) OVER (PARTITION BY m) AS n FROM starts),
gone AS (SELECT DISTINCT row_, i FROM (SELECT row_, unnest(range(k, k + 35)) AS i FROM windows WHERE n > 1)),
words AS (SELECT row_, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM w),
kept AS (SELECT row_, string_agg(word, ' ' ORDER BY i) AS t FROM words x WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.row_ = x.row_ AND g.i = x.i) GROUP BY row_),
removed AS (SELECT row_, count(*) AS n FROM gone GROUP BY row_)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(r.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM w LEFT JOIN removed r ON w.row_ = r.row_ LEFT JOIN kept k ON w.row_ = k.row_"""

#: The digest of every window of 100 bytes, those that stood before, and the spans that they cover.
OP9_SQL = """WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS LAST, md5(coalesce(text, ''))) AS row_, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (SELECT row_, k, md5_number(substr(h, 2 * k + 1, 200)) AS m FROM (SELECT row_, h, unnest(range(0, length(h) // 2 - 99)) AS k FROM d WHERE length(h) >= 200)),
again AS (SELECT row_, k FROM (SELECT row_, k, row_number() OVER (PARTITION BY m ORDER BY row_, k) AS rn FROM starts) WHERE rn > 1),
marked AS (SELECT *, CASE WHEN k <= lag(k) OVER (PARTITION BY row_ ORDER BY k) + 100 THEN 0 ELSE 1 END AS fresh FROM again),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY row_ ORDER BY k) AS island FROM marked),
spans AS (SELECT row_, min(k) AS a, max(k) + 100 AS b FROM islands GROUP BY row_, island),
before AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY row_ ORDER BY a), 0) AS prev FROM spans),
cut AS (SELECT x.row_, count(*) AS n, sum(b - a) AS gone, max(b) AS tail, string_agg(substr(h, CAST(2 * prev + 1 AS BIGINT), CAST(2 * (a - prev) AS BIGINT)), '' ORDER BY a) AS head FROM before x JOIN d ON x.row_ = d.row_ GROUP BY x.row_)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n IS NULL THEN h ELSE head || substr(h, CAST(2 * tail + 1 AS BIGINT)) END)) AS kept_sha256
FROM d LEFT JOIN cut c ON d.row_ = c.row_"""


#: The 256 steps of CRC-32, and the checksum (unsigned) of an expression's bytes in hex, where ``t`` of that table is in reach.
_CRC_TABLE = "crc(t) AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) ORDER BY i) FROM range(256) r(i))"
_CRC = "xor(list_reduce(list_transform(range(1, length({0}), 2), lambda k: CAST('0x' || substr({0}, k, 2) AS BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"


def _manifest_sql(levels: int = 8, above: int = 4) -> str:
    """Level by level: ``levels`` of them within each language (up to 8 ** levels rows), ``above`` over the languages."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    said = lambda lower: "sha256(" + " || ".join(f"coalesce(CAST(octet_length(encode(CAST({f} AS VARCHAR))) AS VARCHAR) || ':' || {f'translate({f}, {chr(39)}{merkle.UPPER}{chr(39)}, {chr(39)}{merkle.LOWER}{chr(39)})' if lower and f == 'text' else f'CAST({f} AS VARCHAR)'}, '-')" for f in fields) + ")"
    tampered = _CRC.format("hex(encode(CAST(doc_id AS VARCHAR)))")
    steps = [f"""WITH {_CRC_TABLE},
leaves AS MATERIALIZED (SELECT *, row_number() OVER () AS row_, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS LAST, leaf) - 1 AS i
  FROM (SELECT doc_id, lang, {said(False)} AS leaf, CASE WHEN text IS NOT NULL AND doc_id IS NOT NULL AND {tampered} % 3 = 0 THEN {said(True)} ELSE {said(False)} END AS told FROM documents CROSS JOIN crc)),
node0 AS MATERIALIZED (SELECT lang, i, leaf AS h FROM leaves),
walk0 AS MATERIALIZED (SELECT row_, lang, i, told AS f, '' AS proof FROM leaves)"""]
    for k in range(levels + above):
        if k == levels:
            steps.append(f"subroot AS MATERIALIZED (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i FROM node{k})")
            steps.append(f"walk{k}a AS MATERIALIZED (SELECT row_, '' AS lang, s.i, f, proof FROM walk{k} w JOIN subroot s ON w.lang IS NOT DISTINCT FROM s.lang)")
        nodes, walk = ("(SELECT '' AS lang, i, h FROM subroot)", f"walk{k}a") if k == levels else (f"node{k}", f"walk{k}")
        steps.append(f"run{k} AS MATERIALIZED (SELECT lang, i // 8 AS i, list(h ORDER BY i) AS kids, any_value(c) AS c FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS c FROM {nodes}) GROUP BY lang, i // 8)")
        steps.append(f"node{k + 1} AS MATERIALIZED (SELECT lang, i, CASE WHEN c = 1 THEN kids[1] ELSE sha256(array_to_string(kids, '')) END AS h FROM run{k})")
        steps.append(f"""walk{k + 1} AS MATERIALIZED (SELECT w.row_, w.lang, w.i // 8 AS i, CASE WHEN c = 1 THEN f ELSE sha256(array_to_string(kids[:w.i % 8] || [f] || kids[w.i % 8 + 2:], '')) END AS f,
  proof || CASE WHEN c = 1 THEN '' ELSE array_to_string(kids[:w.i % 8] || kids[w.i % 8 + 2:], '') END AS proof FROM {walk} w JOIN run{k} r ON w.lang IS NOT DISTINCT FROM r.lang AND w.i // 8 = r.i)""")
    last = levels + above
    return ",\n".join(steps) + f"""
SELECT doc_id, leaf, s.h AS subroot, r.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.h AS verified
FROM leaves l JOIN walk{last} w ON l.row_ = w.row_ JOIN subroot s ON l.lang IS NOT DISTINCT FROM s.lang CROSS JOIN node{last} r"""


OP11_SQL = _manifest_sql()


#: Checksums of distinct features; counts, gains and scores from them.
OP12_SQL = f"""WITH {_CRC_TABLE},
w AS MATERIALIZED (SELECT row_number() OVER () AS row_, doc_id, text, 'd' AS side FROM documents UNION ALL SELECT row_number() OVER (), NULL, text, 'b' FROM benchmark),
ws AS MATERIALIZED (SELECT row_, side, regexp_extract_all(translate(coalesce(text, ''), '{merkle.UPPER}', '{merkle.LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM w),
f AS MATERIALIZED (SELECT row_, side, feature, count(*) AS n FROM (SELECT row_, side, unnest(ws) AS feature FROM ws UNION ALL SELECT row_, side, a || ' ' || b FROM (SELECT row_, side, unnest(ws[:-2]) AS a, unnest(ws[2:]) AS b FROM ws WHERE len(ws) > 1)) GROUP BY ALL),
known AS MATERIALIZED (SELECT feature, {_CRC.format("h")} % 10000 AS bucket FROM (SELECT DISTINCT feature, hex(encode(feature)) AS h FROM f) CROSS JOIN crc),
c AS MATERIALIZED (SELECT bucket, CAST(coalesce(sum(n) FILTER (side = 'd'), 0) AS DOUBLE) AS s, CAST(coalesce(sum(n) FILTER (side = 'b'), 0) AS DOUBLE) AS t FROM f JOIN known USING (feature) GROUP BY bucket),
gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM c) + 10000) / ((s + 1) * ((SELECT sum(t) FROM c) + 10000)))) AS BIGINT) AS g FROM c),
weight AS (SELECT row_, CAST(sum(n) AS BIGINT) AS n_features, CAST(floor(sum(n * g) / sum(n)) AS BIGINT) AS weight FROM f JOIN known USING (feature) JOIN gain USING (bucket) WHERE side = 'd' GROUP BY row_),
scored AS (SELECT row_, doc_id, hash, n_words, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score
  FROM (SELECT w.row_, doc_id, md5(text) AS hash, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS h
  FROM w JOIN ws ON w.side = 'd' AND ws.side = 'd' AND w.row_ = ws.row_ LEFT JOIN weight ON w.row_ = weight.row_)),
drawn AS (SELECT row_, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, hash) AS rank FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 25 * (SELECT count(*) FROM drawn) // 100 THEN rank END AS rank FROM scored LEFT JOIN drawn USING (row_)"""


def oracle_sql() -> dict[str, str]:
    return {"op4_substring": OP4_SQL, "op6_urls": OP6_SQL, "op9_suffix": OP9_SQL, "op11_manifest": OP11_SQL, "op12_resample": OP12_SQL}
