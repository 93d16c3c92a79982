"""The corpus queries: name -> (spark, sf_dir) -> DataFrame, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chat_tree import format_trees, read_back, thread_nodes
from .common import held_out, one_label, table
from .divergence import quality_rules
from .divergence_audit import source_divergence
from .jaccard_join import near_duplicates
from .line_dedup import keep_bitmaps, without_repeats
from .merkle import build_manifest, document_leaves
from .mixing import mix
from .packing import pack_documents
from .quality import quality
from .secrets import scan_secrets, spans_text
from .toxicity import fit_toxicity, toxicity_score, usable_labels
from .url_rules import judge_urls
from .vector_tree import nearest


def _scored(df: DataFrame, parts: int, part: int) -> DataFrame:
    return df.select("doc_id", held_out("doc_id", parts, part).alias("held_out"), "score").withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, usable_labels(labels, held_out("doc_id", 5, 0)))
    return _scored(docs.select("doc_id", toxicity_score(docs, model).alias("score")), 5, 0)


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), threshold=90, k=3).select("doc_id", "n_shingles", "component_id")


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(spans_text(F.col("base_spans")).cast("binary"), 256)
    return found.select("doc_id", *map(number, ("assign", "access", "hex")), base.alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), every=50, k=5)


URL_RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(URL_RULES), "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), rules)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = one_label(table(spark, sf_dir, "labels").where(~held_out("doc_id", 3, 1)), "quality")
    return _scored(quality(table(spark, sf_dir, "documents"), labels), 3, 1)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"), words=None)


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    messages = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    return read_back(format_trees(thread_nodes(messages))).withColumnRenamed("tree_id", "conv_id")


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    made = build_manifest(document_leaves(docs, changed)).proofs()
    kind = docs.schema["doc_id"].dataType
    return made.select(F.col("id").cast(kind).alias("doc_id"), "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(table(spark, sf_dir, "documents")).select("lang", "source", "part", "item", "value", "rank")


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    made = without_repeats(docs, keep_bitmaps(docs))
    return made.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_secret_scans": op3_secret_scans,
    "op4_source_mixing": op4_source_mixing,
    "op5_nearest_neighbours": op5_nearest_neighbours,
    "op6_url_filters": op6_url_filters,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_quality_rules": op8_quality_rules,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_best_fit_packing": op10_best_fit_packing,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_source_divergence": op12_source_divergence,
    "op13_line_dedup": op13_line_dedup,
}

_OP2 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
),
runs AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN w ELSE w[i:i + 2] END AS run
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM words WHERE len(w) > 0)
),
sizes AS (SELECT doc_id, count(*) AS n FROM runs GROUP BY doc_id),
keyed AS (SELECT doc_id, run FROM runs),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o
  FROM keyed a JOIN keyed b ON a.run = b.run AND a.doc_id < b.doc_id GROUP BY 1, 2
),
links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * o >= 90 * (x.n + y.n - o)
),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM edges UNION SELECT r.a, e.b FROM reach r JOIN edges e ON r.b = e.a)
SELECT d.doc_id, coalesce(s.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(min(r.b), d.doc_id)) AS component_id
FROM documents d LEFT JOIN sizes s USING (doc_id) LEFT JOIN reach r ON r.a = d.doc_id
GROUP BY d.doc_id, s.n
"""

_OP6 = r"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
),
judged AS (
  SELECT page_id, host, path, CASE
    WHEN '.' || host LIKE '%.example.org' AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN '.' || host LIKE '%.example.org' AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN '.' || host LIKE '%.com' AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN '.' || host LIKE '%.com' AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN '.' || host LIKE '%.org' AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parts
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""

_OP9 = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
),
sized AS (
  SELECT *, 12 + 1 + 11 + length(text) + length(role)
    + 2 * (length(role) - length(regexp_replace(role, '[%\n<\[|]', '', 'g')))
    + (length(text) - length(replace(text, '\', '')))
    + (length(text) - length(replace(text, '<|', ''))) // 2 + (length(text) - length(replace(text, '|>', ''))) // 2
    + (length(text) - length(replace(text, '<s>', ''))) // 3 + (length(text) - length(replace(text, '</s>', ''))) // 4
    + (length(text) - length(replace(text, '[INST]', ''))) // 6 + (length(text) - length(replace(text, '[/INST]', ''))) // 7 AS chars
  FROM rows
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_LEVELS = 10  # of trees: sixteen to the tenth leaves


def _level(k: int) -> str:
    """The runs of a level, and the nodes above them: a tree of one node stays as it is."""
    return f"""
r{k} AS (SELECT tree, i // 16 AS j, list(h ORDER BY i) AS run, any_value(n) AS n FROM t{k} GROUP BY tree, i // 16),
t{k + 1} AS (SELECT tree, j AS i, CASE WHEN n > 1 THEN sha256(list_aggregate(run, 'string_agg', '')) ELSE run[1] END AS h, CASE WHEN n > 1 THEN (n + 15) // 16 ELSE 1 END AS n FROM r{k}),"""


def _step(k: int) -> str:
    """A row's way through a level: the others of its run join its proof, and its folded digest becomes the run's."""
    left, right = (f"coalesce(list_aggregate(r.run[{part}], 'string_agg', ''), '')" for part in (":p", "p + 2:"))
    return f"""
w{k + 1} AS (
  SELECT f.* EXCLUDE (folded, proof, ix, p), ix // 16 AS ix, CASE WHEN r.n > 1 THEN proof || {left} || {right} ELSE proof END AS proof, CASE WHEN r.n > 1 THEN sha256({left} || folded || {right}) ELSE folded END AS folded
  FROM (SELECT *, ix % 16 AS p FROM w{k}) f JOIN r{k} r ON r.tree = f.tree AND r.j = f.ix // 16
),"""


def _op11() -> str:
    field = lambda c, size: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({size}) || ':' || {c} END"
    head = " || ".join(field(c, f"CAST({c} AS VARCHAR)") for c in ("doc_id", "source", "lang", "n_chars"))
    body = f"""
WITH tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM (SELECT unnest(range(256)) AS i)),
numbers AS (SELECT *, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS digits FROM documents),
crcs AS (SELECT * EXCLUDE (digits), xor(list_reduce(list_prepend(4294967295, digits), lambda c, b: xor(c >> 8, tab[CAST(xor(c & 255, b) AS INTEGER) + 1])), 4294967295) AS crc FROM numbers, tab),
leaves AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '' ELSE 's' || source END AS tree, sha256({head} || {field("text", "text")}) AS leaf,
    sha256({head} || {field("text", "text").replace("'-' ELSE strlen(text) || ':' || text", f"'-' ELSE strlen(text) || ':' || translate(text, {_AZ})")}) AS lowered, coalesce(crc % 5 = 0, false) AS changed FROM crcs
),
t0 AS (SELECT tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, leaf AS h, count(*) OVER (PARTITION BY tree) AS n, doc_id, CASE WHEN changed THEN lowered ELSE leaf END AS now FROM leaves),"""
    body += "".join(_level(k) for k in range(_LEVELS))
    body += f"""
subs AS (SELECT tree AS name, h AS subroot FROM t{_LEVELS}),
t20 AS (SELECT '' AS tree, row_number() OVER (ORDER BY name) - 1 AS i, subroot AS h, count(*) OVER () AS n FROM subs),"""
    body += "".join(_level(k) for k in range(20, 20 + _LEVELS))
    body += "\nw0 AS (SELECT doc_id, tree, h AS leaf, i AS ix, now AS folded, '' AS proof FROM t0),"
    body += "".join(_step(k) for k in range(_LEVELS))
    body += f"""
w20 AS (SELECT w.* EXCLUDE (tree, ix), '' AS tree, s.i AS ix, s.h AS subroot FROM w{_LEVELS} w JOIN subs ON subs.name = w.tree JOIN t20 s ON s.i = (SELECT count(*) FROM subs x WHERE x.name < w.tree)),"""
    body += "".join(_step(k) for k in range(20, 20 + _LEVELS))
    end = 20 + _LEVELS
    return body + f"""
last AS (SELECT 1)
SELECT doc_id, leaf, subroot, (SELECT h FROM t{end}) AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = (SELECT h FROM t{end}) AS verified FROM w{end}
"""


_OP12 = rf"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
groups AS (SELECT DISTINCT lang, source FROM docs),
words AS (SELECT id, lang, source, unnest(w) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM words GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM words JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS total FROM groups g LEFT JOIN counts c USING (lang, source) GROUP BY g.lang, g.source),
shares AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.n, 0) + 2) // (t.total + 2 * l.v) AS BIGINT) AS p, CAST(1 + CAST(1000000000 AS HUGEINT) * (k.n + 2) // (l.total + 2 * l.v) AS BIGINT) AS q
  FROM totals t JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term
),
found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS a, y.source AS b, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL) s
    ON s.lang = a.lang AND s.a = a.source AND s.b = b.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM found
QUALIFY part = 'pair' OR rank <= 10
"""

_OP13 = rf"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT row, doc_id, unnest(range(1, len(lines) + 1)) AS place, unnest(lines) AS line FROM docs),
keyed AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), {_AZ}) AS key FROM lines),
firsts AS (SELECT key, min(doc_id) AS first, count(DISTINCT doc_id) AS docs FROM keyed WHERE length(key) >= 10 GROUP BY key),
judged AS (SELECT k.*, coalesce(f.docs > 1 AND k.doc_id <> f.first, false) AS goes FROM keyed k LEFT JOIN firsts f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT goes), '')) AS kept_sha256 FROM judged GROUP BY row, doc_id
"""

#: The others hold learned models, seeded choices or approximate searches, which SQL cannot express.
ORACLE_SQL: dict[str, str] = {"op2_ngram_jaccard_join": _OP2, "op6_url_filters": _OP6, "op9_chat_formatting": _OP9, "op11_merkle_manifest": _op11(), "op12_source_divergence": _OP12, "op13_line_dedup": _OP13}
