"""Queries over single rows: parsing, filters, rewriting, tagging, line formats."""

from pyspark.sql import functions as F

from logloom.functions.formats import csv_fields, json_line, plain_line, text_line
from logloom.operators import filters, keywords, rewrite, tag
from logloom.operators.ordered import with_rank
from logloom.operators.parse import parse_logs
from logloom.operators.rules import (
    AnnotationRule,
    ClassifyRule,
    EnrichRule,
    LabelRule,
    MaskRule,
    NormalizeRule,
    RedactRule,
    Route,
    ScoreRule,
    SplitRule,
    TransformRule,
)
from logloom.plans.registry import (
    CONVERSATIONS,
    DOCUMENTS,
    EVENTS,
    PAGES,
    PARSED,
    PLAIN_LINE,
    TEXT_LINE,
    query,
)
from logloom.sources.tables import conversation_logs, document_logs, event_lines, event_logs, page_logs

ID = ["source", "seq"]


def _extra(key):
    return F.element_at("extra", F.lit(key)).alias(key)


# Parsing


@query(f"WITH {PARSED} SELECT source, seq, timestamp, epoch_us(ts) AS us, level, service, message, is_json, k FROM logs")
def parse_lines(spark, sf):
    logs = parse_logs(event_lines(spark, sf))
    time = F.unix_micros("ts").alias("us")
    return logs.select(*ID, "timestamp", time, "level", "service", "message", "is_json", _extra("k"))


@query(f"""WITH {PARSED} SELECT coalesce(level, 'error') AS level, is_json, count(*) AS n FROM logs GROUP BY ALL""")
def parse_text_level(spark, sf):
    logs = parse_logs(event_lines(spark, sf), text_level=True)
    return logs.groupBy(F.lower("level").alias("level"), "is_json").agg(F.count("*").alias("n"))


@query(r"""WITH split AS (
  SELECT source, doc_id, unnest(string_split_regex(text, '\r\n|\r|\n')) AS raw,
         generate_subscripts(string_split_regex(text, '\r\n|\r|\n'), 1) - 1 AS pos FROM documents)
SELECT source, (doc_id << 32) + pos AS seq, raw AS message, false AS is_json FROM split
WHERE regexp_matches(raw, '[^\s\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x1c-\x1f]')""")
def parse_plain_lines(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lines = docs.select("source", "doc_id", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("pos", "raw"))
    seq = (F.shiftleft("doc_id", 32) + F.col("pos")).alias("seq")
    return parse_logs(lines.select("source", seq, "raw")).select(*ID, "message", "is_json")


# Filters


@query(f"WITH {DOCUMENTS} SELECT source, seq FROM logs WHERE contains(lower(message), 'eau la')")
def filter_exact(spark, sf):
    return filters.exact_filter(document_logs(spark, sf), "EAU la").select(*ID)


@query(f"WITH {PARSED} SELECT source, seq, message FROM logs WHERE is_json AND lower(level) = 'purchase'")
def filter_level(spark, sf):
    return filters.level_filter(parse_logs(event_lines(spark, sf)), "Purchase").select(*ID, "message")


@query(f"WITH {CONVERSATIONS} SELECT source, seq FROM logs WHERE lower(level) = 'assistant'")
def filter_level_field(spark, sf):
    return filters.level_equals(conversation_logs(spark, sf), "ASSISTANT").select(*ID)


@query(f"WITH {EVENTS} SELECT source, seq FROM logs WHERE ts >= TIMESTAMP '2024-01-15 06:30:00'")
def filter_since(spark, sf):
    return filters.since_filter(event_logs(spark, sf), "2024-01-15 06:30:00").select(*ID)


@query(f"""WITH {EVENTS} SELECT source, seq, message FROM logs
WHERE contains(lower(message), 'value 4') AND lower(level) = 'error' AND ts >= TIMESTAMP '2024-01-05'""")
def filter_chain(spark, sf):
    found = filters.filter_logs(event_logs(spark, sf), "Value 4", level="ERROR", since="2024-01-05 00:00:00")
    return found.select(*ID, "message")


@query(f"WITH {DOCUMENTS} SELECT source, seq FROM logs WHERE service = 'en' AND length(message) > 1000")
def filter_predicate(spark, sf):
    return filters.predicate_filter(document_logs(spark, sf), "service = 'en' AND length(message) > 1000").select(*ID)


def _fuzzy_sql(logs: str, keyword: str, threshold: int) -> str:
    """SQL of the score, straight from its definition, for texts in lower case.

    Each character becomes the bits of its places in the keyword. Folding the bits of a stretch gives the length of its longest
    common subsequence with the keyword; so does folding a text, cut to a stretch of the keyword, for texts that are
    not longer than it.
    """
    m, full = len(keyword), (1 << len(keyword)) - 1
    bits = {c: sum(1 << i for i, x in enumerate(keyword) if x == c) for c in sorted(set(keyword))}
    case = "CASE c " + " ".join(f"WHEN '{c}' THEN {v}" for c, v in bits.items()) + " ELSE 0 END"
    fold = "list_reduce(list_prepend({0}, masks), lambda v, k: ((v + (v & k & {0})) | (v - (v & k & {0}))) & {0})"
    return f"""WITH {logs},
chars AS (SELECT source, seq, unnest(string_split(lower(message), '')) AS c,
                 generate_subscripts(string_split(lower(message), ''), 1) AS pos FROM logs WHERE message <> ''),
codes AS (SELECT source, seq, pos, {case} AS mask, 1 AS inside FROM chars
  UNION ALL SELECT source, seq, p, 0, 0 FROM logs, range({2 - m}, 1) r(p)
  UNION ALL SELECT source, seq, length(message) + p, 0, 0 FROM logs, range(1, {m}) r(p)),
stretches AS (SELECT source, seq, list(mask) OVER w AS masks, sum(inside) OVER w AS inside, count(*) OVER w AS n FROM codes
  WINDOW w AS (PARTITION BY source, seq ORDER BY pos ROWS BETWEEN CURRENT ROW AND {m - 1} FOLLOWING)),
kinds AS (SELECT DISTINCT masks FROM stretches WHERE n = {m}),
lcs AS (SELECT masks, {m} - bit_count({fold.format(full)}) AS lcs FROM kinds),
long AS (SELECT source, seq, max(200.0 * lcs / ({m} + inside)) AS score FROM stretches JOIN lcs USING (masks)
         WHERE n = {m} AND inside > 0 GROUP BY source, seq),
short AS (SELECT source, seq, len, list(mask ORDER BY pos) AS masks FROM codes JOIN
          (SELECT source, seq, length(message) AS len FROM logs WHERE length(message) BETWEEN 1 AND {m}) USING (source, seq)
          WHERE inside = 1 GROUP BY source, seq, len),
parts AS (SELECT source, seq, len, masks, (1 << least(s + len - 1, {m})) - (1 << (greatest(s, 1) - 1)) AS part
          FROM (SELECT *, unnest(range(2 - len, {m} + 1)) AS s FROM short)),
slid AS (SELECT source, seq, max(200.0 * (bit_count(part) - bit_count({fold.format("part")})) / (len + bit_count(part))) AS score
         FROM parts GROUP BY source, seq),
scores AS (SELECT l.source, l.seq, CASE WHEN len < {m} THEN s.score ELSE greatest(l.score, coalesce(s.score, 0)) END AS score
           FROM long l LEFT JOIN (SELECT slid.*, len FROM slid JOIN short USING (source, seq)) s USING (source, seq))
SELECT source, seq FROM scores WHERE round_even(score, 0) >= {threshold}"""


@query(_fuzzy_sql(DOCUMENTS, "thereation of", 75))
def fuzzy_filter(spark, sf):
    return filters.fuzzy_filter(document_logs(spark, sf), "thereation of", 75).select(*ID)


@query(_fuzzy_sql(EVENTS, "purchse", 75))
def fuzzy_filter_short(spark, sf):
    return filters.fuzzy_filter(event_logs(spark, sf), "Purchse", 75).select(*ID)


@query(_fuzzy_sql("logs AS (SELECT source, doc_id AS seq, lang || ' ' || source AS message FROM documents)", "from src1 here", 60))
def fuzzy_filter_long_keyword(spark, sf):
    """A keyword longer than the texts, which then slide along it."""
    logs = document_logs(spark, sf).withColumn("message", F.concat_ws(" ", "service", "source"))
    return filters.fuzzy_filter(logs, "from src1 here", 60).select(*ID)


# Rewriting


@query(rf"""WITH {EVENTS} SELECT source, seq, regexp_replace(level, '^E', 'e!', 'gi') AS level,
regexp_replace(service, 'user-([0-9]+)', 'u\1$', 'gi') AS service,
regexp_replace(regexp_replace(message, ' VALUE ', '=', 'gi'), '=([0-9]+)\.', '=\1,', 'gi') AS message FROM logs""")
def transform(spark, sf):
    rules = [
        TransformRule("level", "^E", "e!"),
        TransformRule("service", r"user-(?P<id>[0-9]+)", r"u\g<id>$"),
        TransformRule("message", " VALUE ", "="),
        TransformRule("message", r"=([0-9]+)\.", r"=\1,"),
    ]
    return rewrite.transform_logs(event_logs(spark, sf), rules).select(*ID, "level", "service", "message")


@query(r"""SELECT source, doc_id AS seq, CAST(NULL AS VARCHAR) AS raw,
regexp_replace(regexp_replace(regexp_replace(text, '[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}', '[EMAIL]', 'gi'),
  '\[EMAIL\]', '[MASKED]', 'gi'), '[0-9]{3,}', '[NUMBER]', 'gi') AS message FROM documents""")
def redact(spark, sf):
    rules = [
        RedactRule("email", r"[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", "[EMAIL]"),
        RedactRule("again", r"\[EMAIL\]", "[MASKED]"),
        RedactRule("numbers", r"[0-9]{3,}", "[NUMBER]"),
    ]
    return rewrite.redact_logs(document_logs(spark, sf), rules).select(*ID, "raw", "message")


@query(rf"""WITH {EVENTS} SELECT source, seq, regexp_replace(k, '[0-9]$', '#', 'g') AS k,
regexp_replace(service, '[0-9]', '#', 'g') AS service FROM logs""")
def redact_extra(spark, sf):
    rules = [RedactRule("digit", "[0-9]$", "#", ("k", "absent")), RedactRule("all", "[0-9]", "#", ("service",))]
    return rewrite.redact_logs(event_logs(spark, sf), rules).select(*ID, _extra("k"), _extra("service"))


@query(f"""WITH {EVENTS} SELECT source, seq, CASE WHEN level = 'purchase' THEN '***' ELSE message END AS message,
CASE WHEN starts_with(message, 'purchase') THEN '<k>' ELSE k END AS k, false AS has_absent FROM logs""")
def mask(spark, sf):
    rules = [
        MaskRule("buys", ("message",), condition=F.col("level") == "purchase"),
        MaskRule("keys", ("k", "absent"), "<k>", F.startswith("message", F.lit("purchase"))),
    ]
    masked = rewrite.mask_logs(event_logs(spark, sf), rules)
    return masked.select(*ID, "message", _extra("k"), F.map_contains_key("extra", F.lit("absent")).alias("has_absent"))


@query(f"""WITH {EVENTS} SELECT source, seq, upper(level) AS level, lower(upper(service)) AS service,
trim(replace(message, 'value', '')) AS message FROM logs""")
def normalize(spark, sf):
    rules = [
        rewrite.uppercase_level_rule(),
        NormalizeRule("service", F.upper),
        rewrite.lowercase_service_rule(),
        NormalizeRule("message", lambda c: F.trim(F.replace(c, F.lit("value"), F.lit("")))),
    ]
    return rewrite.normalize_logs(event_logs(spark, sf), rules).select(*ID, "level", "service", "message")


@query(f"WITH {PAGES} SELECT source, seq, message FROM logs")
def strip_ansi(spark, sf):
    """Tags of the pages are coloured first, so that there is something to strip."""
    coloured = F.regexp_replace("message", "<", "\x1b[1;31m<\x1b[0m")
    logs = page_logs(spark, sf).withColumn("message", coloured)
    return rewrite.normalize_logs(logs, [rewrite.strip_ansi_rule()]).select(*ID, "message")


@query(f"""WITH {DOCUMENTS} SELECT source, seq,
CASE WHEN length(message) > 80 THEN substr(message, 1, 77) || '...' ELSE message END AS message FROM logs""")
def truncate(spark, sf):
    return rewrite.truncate_logs(document_logs(spark, sf), 80).select(*ID, "message")


@query(f"""WITH {EVENTS} SELECT source, seq, substr(message, 1, 5) || '~' AS message,
CASE WHEN length(service) > 6 THEN substr(service, 1, 5) || '~' ELSE service END AS service FROM logs""")
def truncate_extra(spark, sf):
    cut = rewrite.truncate_logs(event_logs(spark, sf), 6, "~", ["service", "absent"])
    return cut.select(*ID, "message", _extra("service"))


@query(rf"""WITH {PAGES} SELECT source, seq, regexp_replace(message, '(a href=)', '<mark>\1</mark>', 'gi') AS message
FROM logs""")
def mark_term(spark, sf):
    return rewrite.mark_logs(page_logs(spark, sf), "A HREF=").select(*ID, "message")


# Tagging


@query(f"""WITH {EVENTS} SELECT source, seq, CASE WHEN level = 'error' THEN 'high' WHEN level = 'purchase' THEN 'mid' END
AS priority, CASE WHEN contains(message, 'value 1') THEN 'true' END AS one, k FROM logs""")
def annotate(spark, sf):
    rules = [
        AnnotationRule("priority", F.col("level").isin("purchase", "error"), "mid"),
        AnnotationRule("priority", F.col("level") == "error", "high"),
        AnnotationRule("one", "contains(message, 'value 1')"),
    ]
    return tag.annotate_logs(event_logs(spark, sf), rules).select(*ID, _extra("priority"), _extra("one"), _extra("k"))


@query(f"""WITH {EVENTS} SELECT source, seq, CASE WHEN level IN ('view', 'click') THEN 'web' ELSE 'core' END AS team,
CASE WHEN level = 'click' THEN 'pointer' WHEN level = 'view' THEN 'eye' END AS kind, k FROM logs""")
def label(spark, sf):
    rules = [
        LabelRule("all", F.lit(True), {"team": "core"}),
        LabelRule("web", F.col("level").isin("view", "click"), {"team": "web", "kind": "eye"}),
        LabelRule("click", F.col("level") == "click", {"kind": "pointer"}),
    ]
    return tag.label_logs(event_logs(spark, sf), rules).select(*ID, _extra("team"), _extra("kind"), _extra("k"))


@query(f"""WITH {EVENTS} SELECT source, seq, source AS host, source || '/' || level AS origin, 'k' || k AS k FROM logs""")
def enrich(spark, sf):
    rules = [
        tag.host_rule(),
        EnrichRule("origin", F.concat_ws("/", F.element_at("extra", F.lit("host")), "level")),
        EnrichRule("k", "concat('k', extra['k'])"),
    ]
    return tag.enrich_logs(event_logs(spark, sf), rules).select(*ID, _extra("host"), _extra("origin"), _extra("k"))


@query(f"""WITH {EVENTS} SELECT source, seq, CAST(row_number() OVER (PARTITION BY source ORDER BY seq) AS VARCHAR) AS index
FROM logs WHERE level = 'error'""")
def enrich_index(spark, sf):
    return tag.add_index(filters.level_equals(event_logs(spark, sf), "error")).select(*ID, _extra("index"))


_CATEGORIES = [
    ClassifyRule("secret", "rlike(message, '(?i)password|api[_-]?key|secret')", "secret"),
    ClassifyRule("mail", "contains(message, '@')", "contact"),
    ClassifyRule("broken", "try_cast(NULL AS boolean)", "never"),
    ClassifyRule("long", "length(message) > 2000", "long"),
]


@query(f"""WITH {DOCUMENTS} SELECT source, seq, CASE WHEN regexp_matches(message, '(?i)password|api[_-]?key|secret')
THEN 'secret' WHEN contains(message, '@') THEN 'contact' WHEN length(message) > 2000 THEN 'long'
ELSE 'uncategorized' END AS category FROM logs""")
def classify(spark, sf):
    return tag.classify_logs(document_logs(spark, sf), _CATEGORIES).select(*ID, "category")


_ROUTES = [
    Route("fives", "contains(message, '5')"),
    Route("errors", "level = 'error'", stop=True),
    Route("all", "true"),
]


@query(f"""WITH {EVENTS}, fanned AS (SELECT source, seq, unnest(list_filter([
CASE WHEN contains(message, '5') THEN 'fives' END, CASE WHEN level = 'error' THEN 'errors' END,
CASE WHEN level <> 'error' THEN 'all' END], lambda r: r IS NOT NULL)) AS route FROM logs)
SELECT source, seq, route FROM fanned""")
def route(spark, sf):
    return tag.explode_routes(event_logs(spark, sf), _ROUTES).select(*ID, "route")


_BUCKETS = [
    SplitRule("errors", "level = 'error'"),
    SplitRule("nines", "contains(message, '9')"),
]
_BUCKET_SQL = "CASE WHEN level = 'error' THEN 'errors' WHEN contains(message, '9') THEN 'nines' ELSE 'default' END"


@query(f"WITH {EVENTS} SELECT source, seq, {_BUCKET_SQL} AS bucket FROM logs")
def split_rows(spark, sf):
    return tag.split_logs(event_logs(spark, sf), _BUCKETS).select(*ID, "bucket")


_SCORES = [
    ScoreRule("error", "level = 'error'", 10),
    ScoreRule("buy", "level = 'purchase'", 2.5),
    ScoreRule("seven", "contains(message, '7')", -1.5),
]
_SCORE_SQL = """CASE level WHEN 'error' THEN 10.0 WHEN 'purchase' THEN 2.5 ELSE 0 END
- CASE WHEN contains(message, '7') THEN 1.5 ELSE 0 END"""


@query(f"WITH {EVENTS} SELECT source, seq, CAST({_SCORE_SQL} AS DOUBLE) AS score FROM logs")
def score(spark, sf):
    return tag.score_logs(event_logs(spark, sf), _SCORES).select(*ID, "score")


@query(f"""WITH {EVENTS}, s AS (SELECT source, seq, CAST({_SCORE_SQL} AS DOUBLE) AS score FROM logs)
SELECT *, row_number() OVER (ORDER BY score DESC, source, seq) AS rank FROM s""")
def score_rank(spark, sf):
    """The complete ranking; ranks are read off the order that it comes in."""
    ranked = tag.rank_logs(event_logs(spark, sf), _SCORES).select(*ID, "score")
    return with_rank(ranked)


@query(f"""WITH {EVENTS} SELECT source, seq, CAST({_SCORE_SQL} AS DOUBLE) AS score FROM logs
ORDER BY score DESC, source, seq LIMIT 100""")
def score_top(spark, sf):
    return tag.rank_logs(event_logs(spark, sf), _SCORES, limit=100).select(*ID, "score")


# Line formats


@query(f"WITH {PARSED} SELECT source, seq, {PLAIN_LINE} AS line FROM logs")
def format_line(spark, sf):
    return parse_logs(event_lines(spark, sf)).select(*ID, plain_line().alias("line"))


@query(f"WITH {PARSED} SELECT source, seq, {TEXT_LINE} AS line FROM logs")
def export_text_rows(spark, sf):
    return parse_logs(event_lines(spark, sf)).select(*ID, text_line().alias("line"))


@query(f"WITH {PARSED} SELECT source, seq, timestamp, coalesce(level, '') AS level, message, raw FROM logs")
def export_csv_rows(spark, sf):
    return parse_logs(event_lines(spark, sf)).select(*ID, *csv_fields())


@query(f"""WITH {PARSED} SELECT source, seq, '{{"timestamp":"' || timestamp || '","level":' ||
coalesce('"' || level || '"', 'null') || ',"message":"' || message || '","raw":"' || replace(raw, '"', '\\"') || '"}}'
AS line FROM logs""")
def export_json_rows(spark, sf):
    return parse_logs(event_lines(spark, sf)).select(*ID, json_line().alias("line"))


def benchmark_rules(spark, sf):
    """A rule per 4-word window of every benchmark passage (words split at ASCII white space, lower case, joined by one
    space): id ``item_id * 100000 + place``, category ``bench-<item_id>``."""
    words = spark.read.parquet(f"{sf}/benchmark.parquet").select(
        "item_id", F.regexp_extract_all(F.lower("text"), F.lit(r"[^\x20\x09-\x0D]+"), 0).alias("w")
    )
    windows = words.select("item_id", F.posexplode(F.expr("transform(sequence(1, greatest(size(w) - 3, 1)), i -> slice(w, i, 4))")).alias("place", "k"))
    return windows.where(F.size("k") == 4).select(
        (F.col("item_id") * 100000 + F.col("place")).alias("rule_id"),
        F.array_join("k", " ").alias("keyword"),
        F.concat(F.lit("bench-"), F.col("item_id").cast("string")).alias("category"),
    )


@query(
    r"""WITH w AS (SELECT item_id, regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
rules AS (
  SELECT item_id * 100000 + i - 1 AS rule_id, array_to_string(w[i:i + 3], ' ') AS keyword, 'bench-' || item_id AS category
  FROM w, range(1, greatest(len(w) - 2, 1)) t(i)),
hits AS (
  SELECT d.doc_id, r.rule_id, r.category FROM documents d JOIN rules r ON contains(lower(d.text), r.keyword))
SELECT d.doc_id, coalesce((SELECT arg_min(category, rule_id) FROM hits h WHERE h.doc_id = d.doc_id), 'uncategorized') AS category,
       (SELECT count(DISTINCT rule_id) FROM hits h WHERE h.doc_id = d.doc_id) AS n_rules
FROM documents d"""
)
def classify_keywords(spark, sf):
    """Documents classified by some thousand keyword rules from a table, all found in one scan of each text."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    matched = keywords.keyword_matches(docs, benchmark_rules(spark, sf), text="text", column="rules", first="category", default="uncategorized")
    return matched.select("doc_id", "category", F.size("rules").cast("long").alias("n_rules"))
