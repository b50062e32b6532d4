"""The corpus operators as queries over the supplied tables, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, html_text, license_scan, merkle, mixing, packing, quality, simhash, sketch, token_alignment, toxicity, transport_stream, url_filter
from .common import read_table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "\\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat_format.digest(chat_format.format_conversations(turns.unionByName(extra)))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the worst label of the documents that its main text carries: bad if of quality 0 or toxic."""
    pages, documents = read_table(spark, sf_dir, "pages"), read_table(spark, sf_dir, "documents")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad"))
    return url_filter.judge_urls(pages, url_filter.page_outcomes(html_text.extract_pages(pages), documents, labels))


def op3_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transport_stream.media_digest(read_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(read_table(spark, sf_dir, "documents"))
    listed = F.array_join(F.transform("licenses", lambda x: F.format_string("%s:%.3f:%d-%d", x["license"], x["coverage"], x["first_word"], x["last_word"])), ";")
    return found.select("doc_id", "license", "coverage", listed.alias("licenses"))


def op6_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch.compare_with_edit_and_next(read_table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(read_table(spark, sf_dir, "pages"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixing_rates(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.fingerprint_text(F.col("fp")).alias("fingerprint"), "component_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents, held against rows whose texts were lower-cased where 5 divides the id's checksum."""
    changed = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    lower = F.translate("text", merkle.UPPER, merkle.UPPER.lower())
    held = F.when(changed, merkle.leaf_digest(*(lower if c == "text" else F.col(c) for c in merkle.LEAF_COLUMNS)))
    return merkle.manifest(read_table(spark, sf_dir, "documents"), held)


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align_documents(read_table(spark, sf_dir, "documents"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_url_filter, op3_transport_stream, op4_toxicity, op5_license_scan, op6_sketch, op7_html_text, op8_mixing, op9_simhash, op10_packing, op11_merkle, op12_token_alignment, op13_quality, pipeline)}

#: Rows by turn; a turn is escaped where its text or role conflicts with the grammar.
_OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT CAST(-7 AS BIGINT), CAST(i AS BIGINT), CASE WHEN i = 0 THEN 'user' ELSE 'assistant' END, '\### Assistant: </turn> ok' FROM range(2) t(i)
), marked AS (
  SELECT *, contains(text, '###') OR contains(text, '</turn>') OR contains(role, '###') OR contains(role, '</turn>') OR contains(role, ': ') AS conflict FROM rows
), rendered AS (
  SELECT *, CASE WHEN conflict
    THEN '###\ ' || replace(replace(replace(replace(role, '\', '\0'), '</turn>', '\1'), '###', '\2'), ':', '\3') || ': ' || replace(replace(replace(replace(text, '\', '\0'), '</turn>', '\1'), '###', '\2'), ':', '\3')
    ELSE '### ' || role || ': ' || text END || '</turn>' || chr(10) AS line FROM marked
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(line)) AS BIGINT) AS formatted_chars
FROM rendered GROUP BY conv_id
"""

_OP2_SQL = r"""
WITH parsed AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages
), articles AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)</article>', 1), '(?s)^.*?</h1>', ''), '<[^>]*>', '', 'g') AS t FROM pages
), carried AS (
  SELECT page_id, md5(regexp_replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '[\s\x1c-\x1f\p{Z}]', '', 'g')) AS mark FROM articles
), known AS (
  SELECT md5(regexp_replace(coalesce(text, ''), '[\s\x1c-\x1f\p{Z}]', '', 'g')) AS mark, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 WHEN quality IS NULL OR toxic IS NULL THEN NULL ELSE 0 END) AS bad FROM documents JOIN labels USING (doc_id) GROUP BY 1
), outcome AS (
  SELECT page_id, max(bad) AS bad FROM carried JOIN known USING (mark) WHERE mark <> md5('') GROUP BY 1
), hosts AS (
  SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS bad FROM parsed LEFT JOIN outcome USING (page_id) GROUP BY 1
), named AS (
  SELECT *, string_split(regexp_replace(regexp_replace(host, ':\d*$', ''), '\.$', ''), '.') AS labels FROM hosts
), deep AS (
  SELECT *, CASE WHEN len(labels) > 1 AND length(labels[-1]) = 2 AND labels[-2] IN ('ac', 'co', 'com', 'edu', 'go', 'gob', 'gouv', 'gov', 'gv', 'ltd', 'me', 'mil', 'ne', 'net', 'nom', 'or', 'org', 'plc', 'sch') THEN 2 ELSE 1 END AS k,
    regexp_full_match(array_to_string(labels, '.'), '(\[.*\]|\d{1,3}(\.\d{1,3}){3})') AS address FROM named
), parts AS (
  SELECT host, n, bad, array_to_string(CASE WHEN address THEN labels ELSE labels[-(k + 1):] END, '.') AS domain, array_to_string(CASE WHEN address THEN labels ELSE labels[-k:] END, '.') AS suffix FROM deep
), domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM parts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
sums AS (
  SELECT level, CAST(sum(n) AS DOUBLE) AS n, CAST(sum(bad) AS DOUBLE) AS k, sum(CAST(bad AS DOUBLE) * bad / n) AS kk, sum(CAST(n AS DOUBLE) * n) AS nn, count(*) AS g
  FROM (SELECT 1 AS level, n, bad FROM suffixes UNION ALL SELECT 2, n, bad FROM domains UNION ALL SELECT 3, n, bad FROM parts) WHERE n > 0 GROUP BY level
), base AS (SELECT *, (k + 0.5) / (n + 1) AS p, n - nn / n - (g - 1) AS room FROM sums),
shrink AS (
  SELECT level, p, least(0.5, greatest(0.001, CASE WHEN room > 0 THEN (kk - k * k / n - p * (1 - p) * (g - 1)) / (p * (1 - p) * room) ELSE 0.001 END)) AS rho FROM base
), m AS (
  SELECT max(p) FILTER (level = 1) AS p, max((1 - rho) / rho) FILTER (level = 1) AS m1, max((1 - rho) / rho) FILTER (level = 2) AS m2, max((1 - rho) / rho) FILTER (level = 3) AS m3 FROM shrink
), posterior AS (
  SELECT h.host, (d.mean * m3 + h.bad) AS a, ((1 - d.mean) * m3 + h.n - h.bad) AS b FROM parts h, m, (
    SELECT d.domain, (s.mean * m2 + d.bad) / (m2 + d.n) AS mean FROM domains d, m, (
      SELECT suffix, (p * m1 + bad) / (m1 + n) AS mean FROM suffixes, m) s WHERE s.suffix = d.suffix) d WHERE d.domain = h.domain
), judged AS (
  SELECT host, a / (a + b) - 1.0 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) > 0.25 AS blocked FROM posterior
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parsed
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN blocked THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN judged USING (host)
"""

#: A cyclic checksum by bits, over the bytes of the id's digits.
_CRC32 = "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda d: ascii(d)::UBIGINT)), lambda c, x: list_reduce(list_prepend(xor(c, x), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384::UBIGINT) ELSE v >> 1 END)), 4294967295::UBIGINT)"


def _leaf_sql(text: str) -> str:
    said = [f"coalesce(CAST(strlen({c}) AS VARCHAR) || ':' || {c}, '-')" for c in ("CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text)]
    return f"sha256({' || '.join(said)})"


#: All nodes of all trees, level by level; a run's siblings are read off the list of its nodes.
_OP11_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || source, '') AS tree, {_leaf_sql('text')} AS leaf,
    CASE WHEN {_CRC32} % 5 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS held FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY tree) AS n FROM leaves
), nodes AS (
  SELECT 0 AS level, tree, place, leaf AS node, n FROM placed
  UNION ALL
  SELECT level + 1, tree, place // 16, sha256(string_agg(node, '' ORDER BY place)), (n + 15) // 16 FROM nodes WHERE n > 1 GROUP BY level, tree, place // 16, n
), subroots AS (
  SELECT tree, node, row_number() OVER (ORDER BY tree) - 1 AS place, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops AS (
  SELECT 0 AS level, place, node, n FROM subroots
  UNION ALL
  SELECT level + 1, place // 16, sha256(string_agg(node, '' ORDER BY place)), (n + 15) // 16 FROM tops WHERE n > 1 GROUP BY level, place // 16, n
), runs AS (
  SELECT 0 AS part, level, tree, place // 16 AS run, list(node ORDER BY place) AS members FROM nodes WHERE n > 1 GROUP BY ALL
  UNION ALL SELECT 1, level, '', place // 16, list(node ORDER BY place) FROM tops WHERE n > 1 GROUP BY ALL
), steps AS (
  SELECT p.doc_id, p.leaf, p.place, p.tree, r.part, r.level, r.members, (p.place // CAST(power(16, r.level) AS BIGINT)) % 16 AS k
  FROM placed p JOIN runs r ON r.part = 0 AND r.tree = p.tree AND r.run = p.place // CAST(power(16, r.level + 1) AS BIGINT)
  UNION ALL
  SELECT p.doc_id, p.leaf, p.place, p.tree, r.part, r.level, r.members, (s.place // CAST(power(16, r.level) AS BIGINT)) % 16
  FROM placed p JOIN subroots s USING (tree) JOIN runs r ON r.part = 1 AND r.run = s.place // CAST(power(16, r.level + 1) AS BIGINT)
), sides AS (
  SELECT *, array_to_string(members[:k], '') AS before, array_to_string(members[k + 2:], '') AS after FROM steps
), paths AS (
  SELECT tree, place, sha256(string_agg(before || after, '' ORDER BY part, level)) AS proof, list(before || '|' || after ORDER BY part, level) AS path FROM sides GROUP BY tree, place
), folded AS (
  SELECT p.doc_id, p.leaf, s.node AS subroot, (SELECT node FROM tops WHERE n = 1) AS root, coalesce(q.proof, sha256('')) AS proof_sha256,
    list_reduce(list_prepend(coalesce(p.held, p.leaf), coalesce(q.path, [])), lambda x, y: sha256(split_part(y, '|', 1) || x || split_part(y, '|', 2))) AS folded_root
  FROM placed p JOIN subroots s USING (tree) LEFT JOIN paths q ON q.tree = p.tree AND q.place = p.place
)
SELECT *, folded_root = root AS verified FROM folded
"""

ORACLE_SQL: dict[str, str] = {"op1_chat_format": _OP1_SQL, "op2_url_filter": _OP2_SQL, "op11_merkle": _OP11_SQL}
