"""The registered queries of the corpus operators, over whole tables, and their SQL."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm.bpe import bpe_decode, bpe_encode
from flowspark.llm.common import delete_folder, lower_ascii, table
from flowspark.llm.decontaminate import contaminated
from flowspark.llm.exact_dedup import exact_dedup
from flowspark.llm.language_id import declared_language, domain_of, fit, host_of, identify, page_text, sample_of, suffix_of
from flowspark.llm.line_dedup import drop_common_lines
from flowspark.llm.mixing import mix_sources, words_of
from flowspark.llm.ordering import lookup, positions
from flowspark.llm.phrases import collocations
from flowspark.llm.pii import replace_pii
from flowspark.llm.simhash import simhash_components
from flowspark.llm.suffix_tree import score_texts
from flowspark.llm.trie import numbered_turns, prefix_trie
from flowspark.llm.url_filter import judge_urls
from flowspark.llm.warc import read_warc, warc_records, write_warc
from flowspark.session import durable, shared_dir


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(lower_ascii(F.coalesce("text", F.lit(""))), 256))
    return exact_dedup(docs, carry=("text_sha256",))


OP1_SQL = """
WITH t AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)
"""


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key is fixed here so that runs can be compared; in production it is a secret."""
    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), key=b"surrogates of the registered query")


def op4_bpe(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> DataFrame:
    """Round trip of whole texts; the digests are those of the real ids and of the text decoded from them."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    coded = bpe_encode(docs.select("doc_id", "text"), path)
    coded = coded.select("doc_id", "ids", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"))
    return bpe_decode(coded, path).select("doc_id", "n_tokens", "ids_sha256", F.sha2("text", 256).alias("decoded_sha256"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select("doc_id", F.col("item").alias("item_id"), "overlap", "matched")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


#: A document is a row, also where ids repeat, as in the operator.
OP8_SQL = """
WITH split AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
lines AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS k FROM split),
keyed AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
),
common AS (SELECT key FROM keyed WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
marked AS (SELECT keyed.*, common.key IS NOT NULL AS gone FROM keyed LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id
"""


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (text and source as host) and pages (text, lang attribute, suffix and host of the address) in one
    run of all rows; doc_id or page_id is null in rows of the other table. The classifier is fitted on documents."""
    docs, pages = table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages")
    labels, weights = fit(sample_of(docs, "lang", 400), "text", "lang")
    none = F.lit(None).cast("string")
    host = host_of(F.col("url"))
    rows = docs.select("doc_id", F.lit(None).cast("long").alias("page_id"), "text", F.concat(F.lit("source:"), "source").alias("host"), none.alias("domain"), none.alias("suffix"), none.alias("declared"))
    rows = rows.unionByName(
        pages.select(
            F.lit(None).cast("long").alias("doc_id"), "page_id", page_text(F.col("html")).alias("text"), host.alias("host"),
            domain_of(host).alias("domain"), suffix_of(host).alias("suffix"), declared_language(F.col("html")).alias("declared"),
        )
    )
    return identify(rows, labels, weights, declared=F.col("declared"), suffix=F.col("suffix"), host=F.col("host"), domain=F.col("domain"), carry=("doc_id", "page_id"))


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the pages as archives in the shared folder and reads them back; all columns come from the archives."""
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    pages = warc_records(table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("target_uri"), "html"), "page_id", "html")
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    records = pages.select(urn("page_id").alias("record_id"), "record_type", "target_uri", urn("refers_to").alias("refers_to"), "payload_bytes", "payload_digest", "chunk_no", "data")
    write_warc(records, path)
    page = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)")
    ends = read_warc(spark, path, with_data=False).where("is_last")
    out = durable(ends.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")))
    delete_folder(spark, path)
    return out


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""

URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "action string, host string, path string")
    return judge_urls(table(spark, sf_dir, "pages"), rules, carry=("page_id",))


OP10_SQL = """
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM u
),
rules(action, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (
  SELECT h.*, action, rhost || rpath AS rule,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC NULLS LAST) AS k
  FROM h LEFT JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict FROM fits WHERE k = 1
"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP11_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang,
         regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS pieces
  FROM documents
),
p AS (SELECT lang, doc, generate_subscripts(pieces, 1) AS piece, regexp_extract_all(unnest(pieces), '[^\\x20\\x09]+') AS words FROM d),
w AS (SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM p),
f AS (
  SELECT lang, words[i:i + m - 1] AS phrase, m, count(*) AS f
  FROM w, (VALUES (1), (2), (3)) AS t(m) WHERE i + m - 1 <= len(words) GROUP BY 1, 2, 3
),
totals AS (SELECT lang, count(*) AS n FROM w GROUP BY 1),
c AS (SELECT * FROM f WHERE m > 1 AND f >= 10),
inner_ AS (SELECT lang, phrase[i:i + 1] AS phrase, max(f) AS longer FROM c, (VALUES (1), (2)) AS t(i) WHERE m = 3 GROUP BY 1, 2),
kept AS (SELECT c.* FROM c LEFT JOIN inner_ i ON c.lang = i.lang AND c.phrase = i.phrase WHERE longer IS NULL OR 100 * longer < 50 * f),
cuts AS (
  SELECT k.lang, k.phrase, k.f AS a, t.k AS k, x.f AS l, y.f AS r,
         CAST((CAST(1000000 AS HUGEINT) * k.f * k.f) // (CAST(x.f AS HUGEINT) * y.f) AS BIGINT) AS score
  FROM kept k, (VALUES (1), (2)) AS t(k), f x, f y
  WHERE t.k < k.m AND x.lang = k.lang AND x.phrase = k.phrase[1:t.k] AND y.lang = k.lang AND y.phrase = k.phrase[t.k + 1:]
),
lowest AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS choice FROM cuts),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(phrase, ' ')) AS rank,
         array_to_string(phrase, ' ') AS phrase, a, l, r, score
  FROM lowest WHERE choice = 1
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in full: sources weigh 1, 2, 3, 1, ... in order of their code points, null last."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", words_of(F.col("text")).alias("size"))
    docs = durable(docs)
    names = positions(docs.select("source").distinct(), "n", [], [F.col("source").asc_nulls_last()])
    weights = names.select("source", ((F.col("n") - 1) % 3 + 1).alias("weight"))
    taken, sources, _ = mix_sources(docs, weights, "source")
    sources = sources.select("source", "source_size", "target")
    out = taken.withColumn("source", F.col("pattern")[0]).alias("d").join(F.broadcast(sources).alias("s"), F.expr("d.source <=> s.source"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


OP12_SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size,
         CAST('0x' || substr(md5('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS draw
  FROM documents
),
s AS (SELECT source, sum(size)::DOUBLE AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
w AS (SELECT source, source_size, (((n - 1) % 3) + 1)::DOUBLE AS weight, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM s),
f AS (  -- the first sources by limit to weight are held to it, as few as leaves no other above its own
  SELECT *, row_number() OVER o - 1 AS k, total - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
  FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)
),
level AS (SELECT left_over, weights FROM f WHERE weight * left_over / weights <= cap ORDER BY k LIMIT 1),
t AS (
  SELECT source, source_size::BIGINT AS source_size, least(weight * left_over / weights, cap) AS target,
         floor(least(weight * left_over / weights, cap) + 0.5)::BIGINT AS quota
  FROM w, level
),
r AS (
  SELECT d.*, source_size, target, CASE WHEN source_size > 0 THEN least(quota, 3 * source_size) // source_size ELSE 0 END AS copies,
         CASE WHEN source_size > 0 THEN least(quota, 3 * source_size) % source_size ELSE 0 END AS rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size::BIGINT AS size, source_size, target, (copies * size + greatest(0, least(size, rest - start)))::BIGINT AS taken FROM r
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations of whole tables, rebuilt so that they share beginnings: the first h turns of conversation c - c % 20, then
    the conversation's own turns after its first h, with h = crc32(c) % 4. Only digests of turns are moved about."""
    shared = F.crc32(F.col("conv_id").cast("string")) % 4
    turns = durable(numbered_turns(table(spark, sf_dir, "conversations")))
    convs = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumn("h", shared).withColumn("base", F.col("conv_id") - F.col("conv_id") % 20)
    bases = convs.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base"))
    convs = convs.join(bases, "base", "left").withColumn("led", F.least("h", F.coalesce("n_base", F.lit(0))))
    convs = durable(convs.select("conv_id", "base", "h", "led", "n", (F.col("led") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("turns")))
    heads = turns.where("pos <= 3 and conv_id % 20 = 0").withColumnRenamed("conv_id", "base")
    led = convs.where("led > 0").join(heads, "base").where("pos <= led").withColumn("depth", F.col("pos"))
    own = lookup(turns, convs.select("conv_id", "h", "led", "n", "turns"), ["conv_id"], "n").where("pos > h").withColumn("depth", F.col("pos") - F.col("h") + F.col("led"))
    names = ["conv_id", "depth", "t1", "t2", "words", "turns"]
    return prefix_trie(led.select(*names).unionByName(own.select(*names)), convs.where("turns = 0"))


OP13_SQL = """
WITH RECURSIVE turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
),
convs AS (
  SELECT conv_id, conv_id - conv_id % 20 AS base,
         xor(4294967295, list_reduce(CAST(encode(CAST(conv_id AS VARCHAR)) AS VARCHAR).split('').list_transform(lambda c: ascii(c)::BIGINT),
           lambda crc, b: list_reduce(range(8), lambda x, i: xor(x >> 1, (x & 1) * 3988292384), xor(crc, b)), 4294967295)) % 4 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
),
rebuilt AS (
  SELECT c.conv_id, t.role, t.text, 0 AS part, pos FROM convs c JOIN turns t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL SELECT c.conv_id, t.role, t.text, 1, pos FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h
),
whole AS (
  SELECT c.conv_id, coalesce(list(md5(struct_pack(a := role, b := text)::JSON::VARCHAR) ORDER BY part, pos) FILTER (WHERE role IS NOT NULL), []) AS turns,
         coalesce(list(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) ORDER BY part, pos) FILTER (WHERE role IS NOT NULL), []) AS words
  FROM convs c LEFT JOIN rebuilt r ON c.conv_id = r.conv_id GROUP BY c.conv_id
),
seen AS (SELECT conv_id, d, turns[1:d] AS node, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS words, len(turns) = d AS at_end FROM whole, unnest(range(0, len(turns) + 1)) AS t(d)),
nodes AS (
  SELECT node, d, min(conv_id) AS conv_id, count(*) AS n_convs, max(words) AS words,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE at_end), '')) AS ends_sha256
  FROM seen GROUP BY node, d
),
children AS (SELECT node[1:d - 1] AS node, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY 1, 2),
own AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c ON n.node = c.node AND n.d = c.d),
below AS (
  SELECT node[1:e] AS node, e AS d, sum((n_children = 0)::BIGINT) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM own, unnest(range(0, d + 1)) AS t(e) GROUP BY 1, 2
)
SELECT n.conv_id, n.d::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, b.n_leaves::BIGINT AS n_leaves,
       b.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM own n JOIN below b ON n.node = b.node AND n.d = b.d LEFT JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.node = n.node[1:n.d - 1]
"""

QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_simhash": op2_simhash,
    "op3_pii": op3_pii,
    "op4_bpe": op4_bpe,
    "op5_suffix_tree": op5_suffix_tree,
    "op6_warc": op6_warc,
    "op7_decontaminate": op7_decontaminate,
    "op8_line_dedup": op8_line_dedup,
    "op9_language_id": op9_language_id,
    "op10_url_filter": op10_url_filter,
    "op11_collocations": op11_collocations,
    "op12_mixing": op12_mixing,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE_SQL = {"op1_exact_dedup": OP1_SQL, "op6_warc": OP6_SQL, "op8_line_dedup": OP8_SQL, "op10_url_filter": OP10_SQL, "op11_collocations": OP11_SQL, "op12_mixing": OP12_SQL, "op13_prefix_trie": OP13_SQL}
