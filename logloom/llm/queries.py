"""The queries of this subpackage over the driver tables, and SQL that gives the same rows where SQL can."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.checkpoints import materialize, scratch_path
from logloom.llm import boosting, bpe, chat, classifier, covertree, jaccard, kmeans, mixing, packing, prefix_trie, urls, warc, wavelet
from logloom.llm.texts import thirds

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(build: Query) -> Query:
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLES[build.__name__] = sql
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query()
def op1_wavelet_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = wavelet.write_shards(docs, scratch_path(spark, "wavelet"), TOKENIZER, end_id=2, special_tokens=True)
    return wavelet.read_documents(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")


@query()
def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(table(spark, sf_dir, "documents"), TOKENIZER, capacity=2048, end_id=0, special_tokens=True)


@query(
    f"""
WITH d AS (
  SELECT doc_id, source, {_WORDS} AS size,
         (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) + 0.5) / 281474976710656 AS u
  FROM documents),
totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM d GROUP BY source),
fills AS (SELECT *, (place - 1) % 3 + 1 AS weight, 3.0::DOUBLE * source_size / ((place - 1) % 3 + 1) AS fills FROM totals),
levels AS (
  SELECT *, (sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER before, 0))::DOUBLE
            / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0))::DOUBLE AS level
  FROM fills WINDOW before AS (ORDER BY fills, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
common AS (SELECT level AS common FROM levels WHERE level <= fills ORDER BY fills, place LIMIT 1),
targets AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, weight * common) AS target FROM levels, common),
shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3) ELSE 0 END::BIGINT AS copies FROM targets),
rests AS (SELECT *, greatest(target - copies * source_size, 0.0::DOUBLE) AS rest FROM shares),
ranked AS (
  SELECT d.*, source_size, target, copies, rest, CASE WHEN source_size > 0 THEN rest / source_size ELSE 0 END AS share
  FROM d JOIN rests r ON d.source IS NOT DISTINCT FROM r.source),
odds AS (SELECT *, u / (1 - u) / 1.0::DOUBLE * (1 - share) / greatest(share, 1e-12::DOUBLE) AS odds FROM ranked),
drawn AS (
  SELECT *, share > 0 AND sum(size) OVER (PARTITION BY source ORDER BY odds, doc_id, size ROWS UNBOUNDED PRECEDING) <= rest AS drawn
  FROM odds),
gaps AS (
  SELECT *, rest - coalesce(sum(size) FILTER (WHERE drawn) OVER (PARTITION BY source), 0) AS gap FROM drawn),
last AS (
  SELECT doc_id AS last_id FROM gaps
  WHERE NOT drawn AND size > 0 AND copies < 3 AND gap > 0
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(size - gap), odds, doc_id, size) = 1 AND abs(size - gap) < gap)
SELECT doc_id, size, source_size, target, ((copies + CASE WHEN drawn OR last_id IS NOT NULL THEN 1 ELSE 0 END) * size)::BIGINT AS taken
FROM gaps LEFT JOIN last ON doc_id = last_id"""
)
def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


_CONTROL = "</s>[INST] ok [/INST]"


def _escaped(column: str) -> str:
    """SQL of the default template's escapes."""
    out = rf"replace({column}, '\', '\\')"
    for control in ("[INST]", "[/INST]", "</s>"):
        out = rf"replace({out}, '{control}', '{control[0]}\{control[1:]}')"
    return out


@query(
    f"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '{_CONTROL}'), (-1, 1, 'assistant', '{_CONTROL}')),
whole AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         sum(length({_escaped("role")}) + length({_escaped("text")}) + 17) AS chars
  FROM said GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(chars AS BIGINT) AS formatted_chars
FROM whole"""
)
def op5_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").cast("int").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(_CONTROL).alias("text"),
    )
    trees = chat.linear_trees(said.unionByName(own), "conv_id", "turn", "role", "text")
    written = materialize(chat.format_reply_trees(trees, branches=1), "chat-formatted")
    back = chat.read_conversations(written)
    newline = F.lit("\n")
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], newline, t["text"], newline)), "")
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss_text").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


@query(
    r"""
WITH payloads AS (SELECT page_id, coalesce(html, '') AS html, CAST(unhex(sha1(coalesce(html, ''))) AS BIT) AS bits FROM pages),
named AS (
  SELECT page_id, html, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + 16 * get_bit(bits, CAST(5 * i AS INTEGER)) + 8 * get_bit(bits, CAST(5 * i + 1 AS INTEGER)) + 4 * get_bit(bits, CAST(5 * i + 2 AS INTEGER))
      + 2 * get_bit(bits, CAST(5 * i + 3 AS INTEGER)) + get_bit(bits, CAST(5 * i + 4 AS INTEGER)), 1)), '') AS digest,
    max(page_id) OVER (PARTITION BY html) AS largest
  FROM payloads)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM named"""
)
def op7_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.write_bundles(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return warc.read_bundles(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


#: The rules of the query, and the host labels whose pages make up its list.
URL_RULES = [
    urls.UrlRule("net", "/", "block"),
    urls.UrlRule("example.net", "/en/", "allow"),
    urls.UrlRule("example.com", "/de/", "block"),
    urls.UrlRule("org", "/fr/", "allow"),
]
LISTED_LABELS = r"(^|\.)(ads-track|cheap-pills|free-bets|spam-farm)\."


@query(
    rf"""
WITH cut AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
named AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
keyed AS (
  SELECT *, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '')
                                      || regexp_replace(path, '/+$', '') || '/' END AS canonical
  FROM named),
listed AS (SELECT DISTINCT canonical AS entry FROM keyed WHERE regexp_matches(host, '{LISTED_LABELS}')),
ruled AS (
  SELECT *, CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                 WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                 WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                 WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM keyed)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN entry IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM ruled LEFT JOIN listed ON canonical = entry"""
)
def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    host, _ = urls.host_and_path(F.col("url"))
    listed = pages.where(host.rlike(LISTED_LABELS)).select("url")
    return urls.judge_urls(pages, listed, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query()
def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = classifier.fit_classifier(docs, table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", (thirds(F.col("doc_id")) == 1).alias("held_out"), classifier.quality_score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query()
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    forest = boosting.fit_rules(docs, table(spark, sf_dir, "labels"))
    return boosting.quality_rules(docs.select("doc_id", "text"), forest).select("doc_id", "verdict.*")


@query(
    """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, d.vec_id, CAST(list_dot_product(q.v, d.v) AS BIGINT) AS score
  FROM whole q JOIN whole d ON q.vec_id % 20 = 0 AND d.vec_id <> q.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 20"""
)
def op10_cover_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    vectors = rows.select("vec_id", covertree.integer_vectors(rows).alias("v"))
    return covertree.top_k_products(vectors, F.col("vec_id") % 20 == 0, k=20)


@query(
    r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
placed AS (SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM split WHERE len(words) >= 4),
windows AS (
  SELECT doc_id, word || ' ' || lead(word, 1) OVER w || ' ' || lead(word, 2) OVER w || ' ' || lead(word, 3) OVER w AS shingle
  FROM placed WINDOW w AS (PARTITION BY doc_id ORDER BY place)),
shingles AS (
  SELECT DISTINCT doc_id, shingle FROM windows WHERE shingle IS NOT NULL
  UNION ALL SELECT doc_id, array_to_string(words, ' ') FROM split WHERE len(words) BETWEEN 1 AND 3),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
links AS (
  SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM documents LEFT JOIN sizes USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)"""
)
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_components(table(spark, sf_dir, "documents"), width=4, percent=85)


@query()
def op11_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.bpe_encode(table(spark, sf_dir, "documents").select("doc_id", "text"), WORD_TOKENIZER)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def _kmeans_sql(rounds: int, k: int, dims: int) -> str:
    """Lloyd rounds written out: assign every kept vector to its nearest centroid, move each non-empty one."""
    distance = "list_sum(list_transform(v, lambda x, i: (x - c[i]) * (x - c[i])))"
    steps = [
        f"""kept AS (
  SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (
  SELECT (row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1)::INTEGER AS cluster, v AS c
  FROM kept WHERE vec_id IS NOT NULL ORDER BY sha256('1:' || vec_id), v LIMIT {k})"""
    ]
    for r in range(rounds + 1):
        steps.append(
            f"""a{r} AS (
  SELECT vec_id, any_value(v) AS v, arg_min(cluster, d * {k} + cluster) AS cluster, min(d) AS distance
  FROM (SELECT row, vec_id, v, cluster, {distance} AS d FROM kept JOIN c{r} ON true) GROUP BY row, vec_id)"""
        )
        if r < rounds:
            steps.append(
                f"""s{r} AS (
  SELECT cluster, i, sum(v[i]) AS s, count(*) AS n FROM a{r}, range(1, {dims + 1}) t(i) GROUP BY cluster, i),
c{r + 1} AS (
  SELECT c{r}.cluster, coalesce(m.c, c{r}.c) AS c FROM c{r} LEFT JOIN (
    SELECT cluster, list((s - ((s % n + n) % n)) // n ORDER BY i) AS c FROM s{r} GROUP BY cluster) m USING (cluster))"""
            )
    return (
        "WITH "
        + ",\n".join(steps)
        + f"""
SELECT vec_id, cluster, distance::BIGINT AS distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia,
       (sum(distance) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (cluster)"""
    )


@query(_kmeans_sql(rounds=3, k=16, dims=64))
def op12_drift_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    vectors = rows.select("vec_id", kmeans.integer_vectors(F.col("embedding"), 64).alias("v")).where(F.col("v").isNotNull())
    assigned, centroids = kmeans.drift_kmeans(vectors, "v", kmeans.hash_seeds(vectors, "vec_id", "v", 16), rounds=3)
    report = kmeans.cluster_report(assigned, centroids)
    return report.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@query(
    r"""
WITH RECURSIVE t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS k
  FROM conversations WHERE conv_id IS NOT NULL),
lens AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
bits(cid, s, i, crc) AS (
  SELECT conv_id, conv_id::VARCHAR, 0, 4294967295::BIGINT FROM lens
  UNION ALL
  SELECT cid, s, i + 1, xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)
  FROM (SELECT cid, s, i, CASE WHEN i % 8 = 0 THEN xor(crc, ascii(substr(s, i // 8 + 1, 1))) ELSE crc END AS x
        FROM bits WHERE i < 8 * length(s))),
c AS (
  SELECT cid, cid - cid % 20 AS b, xor(crc, 4294967295) % 4 AS h FROM bits WHERE i = 8 * length(s)),
rb AS (
  SELECT c.cid, t.k AS pos, t.role, t.text FROM c JOIN t ON t.conv_id = c.b AND t.k < c.h
  UNION ALL
  SELECT c.cid, least(c.h, coalesce(l.n, 0)) + t.k - c.h, t.role, t.text
  FROM c LEFT JOIN lens l ON l.conv_id = c.b JOIN t ON t.conv_id = c.cid AND t.k >= c.h),
seqs AS (
  SELECT c.cid, coalesce(list({'role': rb.role, 'text': rb.text} ORDER BY rb.pos) FILTER (WHERE rb.pos IS NOT NULL), []) AS s
  FROM c LEFT JOIN rb ON rb.cid = c.cid GROUP BY c.cid),
pref AS (SELECT cid, d, list_slice(s, 1, d) AS p, len(s) AS l FROM seqs CROSS JOIN LATERAL generate_series(0, len(seqs.s)) g(d)),
nodes AS (
  SELECT p, d AS depth, min(cid) AS conv_id, count(*) AS n_convs,
         coalesce(sha256(string_agg(cid::VARCHAR, ',' ORDER BY cid) FILTER (WHERE l = d)), sha256('')) AS ends_sha256
  FROM pref GROUP BY p, d),
valued AS (
  SELECT *, (n_convs - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(p[depth].text, '[^\x20\x09-\x0D]+')) END AS own
  FROM nodes),
kids AS (
  SELECT n.p, count(m.p) AS n_children FROM valued n LEFT JOIN valued m ON m.depth = n.depth + 1 AND list_slice(m.p, 1, n.depth) = n.p
  GROUP BY n.p),
sub AS (
  SELECT n.p, sum(m.own) AS saved, count(*) FILTER (WHERE k.n_children = 0) AS leaves
  FROM valued n JOIN valued m ON m.depth >= n.depth AND list_slice(m.p, 1, n.depth) = n.p JOIN kids k ON k.p = m.p GROUP BY n.p)
SELECT n.conv_id::BIGINT AS conv_id, n.depth::BIGINT AS depth, par.conv_id::BIGINT AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
       k.n_children::BIGINT AS n_children, s.leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM valued n JOIN kids k ON k.p = n.p JOIN sub s ON s.p = n.p
LEFT JOIN valued par ON par.depth = n.depth - 1 AND par.p = list_slice(n.p, 1, n.depth - 1)"""
)
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, convs = prefix_trie.rebuilt_turns(table(spark, sf_dir, "conversations"))
    nodes = prefix_trie.prefix_trie(prefix_trie.weighted_sequences(turns, members=convs))
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
