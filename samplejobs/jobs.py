"""The registered queries: a Spark job and, next to it, the SQL with the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samplejobs import derived, expected, rule_samples
from veilspark.functions import checks
from veilspark.functions import patterns as P
from veilspark.functions.text import ENTROPY_SQL, entropy, find_all, searchable
from veilspark.operators import assignments, audits, keywords, naming, reports, resolve
from veilspark.operators.keeping import new_folder
from veilspark.operators.restoring import restore, tokens
from veilspark.plans import sql
from veilspark.plans.scan import candidates, scan
from veilspark.sources.documents import lines, read_documents, write_scan
from veilspark.sources.rules import Catalogue
from veilspark.streaming.masking import read_committed, write_masked

Job = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Job] = {}
ORACLES: dict[str, str] = {}


def job(name: str, sql: str | None = None) -> Callable[[Job], Job]:
    def add(fn: Job) -> Job:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(spark, f"{sf_dir}/documents.parquet")


def document_scan(spark: SparkSession, sf_dir: str, categories=None):
    return scan(documents(spark, sf_dir), "text", ["doc_id"], categories)


def log_scan(spark: SparkSession, sf_dir: str, categories=None):
    return scan(derived.service_log(spark, sf_dir), "text", ["log_id"], categories)


# ---- sources ----


@job(
    "load_documents",
    "SELECT doc_id, length(text) AS n_chars, strlen(text) AS n_bytes FROM documents",
)
def load_documents(spark, sf_dir):
    return documents(spark, sf_dir).select(
        "doc_id", F.length("text").cast("bigint").alias("n_chars"), F.octet_length("text").cast("bigint").alias("n_bytes")
    )


_LINES = """
  split AS (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents),
  numbered AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS line_no FROM split)
"""


@job(
    "doc_lines",
    f"""WITH {_LINES}
    SELECT doc_id, line_no, line, CAST(coalesce(sum(length(line) + 1) OVER (
      PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS line_start
    FROM numbered""",
)
def doc_lines(spark, sf_dir):
    return lines(documents(spark, sf_dir), "text", ["doc_id"]).select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), "line", F.col("line_start").cast("bigint").alias("line_start")
    )


def _rule_values(columns: Callable[[dict], str], rows: list[dict]) -> str:
    return ", ".join(f"({columns(r)})" for r in rows)


def _text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


_RULES = Catalogue().as_rows()
_PAIRS = "pairs(keyword, rule_id, multiline) AS (VALUES " + ", ".join(
    f"({_text(k)}, {_text(r['rule_id'])}, {r['multiline']})" for r in _RULES for k in r["keywords"]
) + ")"
_CATALOGUE = "rules(seq, rule_id, label, category, tier, multiline, entropy) AS (VALUES " + ", ".join(
    f"({r['seq']}, {_text(r['rule_id'])}, {_text(r['label'])}, {_text(r['category'])}, {r['tier']}, {r['multiline']}, "
    f"{'NULL' if r['entropy'] is None else 'CAST(' + str(r['entropy']) + ' AS DOUBLE)'})"
    for r in _RULES
) + ")"


@job(
    "keyword_candidates",
    f"""WITH {_LINES}, {_PAIRS}
    SELECT DISTINCT doc_id, line_no, rule_id FROM numbered JOIN pairs ON contains(lower(line), keyword) WHERE NOT multiline""",
)
def keyword_candidates(spark, sf_dir):
    source = lines(documents(spark, sf_dir), "text", ["doc_id"])
    return keywords.keyword_candidates(source, ["doc_id", "line_no"]).select(
        "doc_id", F.col("line_no").cast("bigint").alias("line_no"), "rule_id"
    )


@job(
    "rule_keywords",
    f"""WITH {_PAIRS}, hits AS (SELECT keyword, count(*) AS n FROM documents
          JOIN (SELECT DISTINCT keyword FROM pairs) k ON contains(lower(text), keyword) GROUP BY keyword)
    SELECT pairs.keyword, rule_id, coalesce(n, 0) AS n_documents FROM pairs LEFT JOIN hits ON hits.keyword = pairs.keyword""",
)
def rule_keywords(spark, sf_dir):
    """Every (keyword, rule) pair with the number of documents that hold the keyword."""
    pairs = Catalogue().keyword_table(spark).select("keyword", "rule_id")
    found = keywords.keywords_in(F.lower("text"), [k for r in _RULES for k in r["keywords"]])
    hits = (
        documents(spark, sf_dir)
        .select(F.explode_outer(found).alias("keyword"))
        .where(F.col("keyword").isNotNull())
        .groupBy("keyword")
        .agg(F.count("*").alias("n"))
    )
    return pairs.join(hits, "keyword", "left").select("keyword", "rule_id", F.coalesce("n", F.lit(0)).alias("n_documents"))


@job(
    "rule_catalogue",
    f"""WITH {_CATALOGUE}, {derived.sql_service_log()}
    SELECT rules.rule_id, rules.label, rules.category, rules.tier, rules.multiline, rules.entropy,
           coalesce(n, 0) AS n_findings
    FROM rules LEFT JOIN (SELECT rule, count(*) AS n FROM log_findings GROUP BY rule) f ON f.rule = rules.rule_id""",
)
def rule_catalogue(spark, sf_dir):
    """Every rule with the number of its findings in the derived logs."""
    found = log_scan(spark, sf_dir).findings.groupBy("rule").agg(F.count("*").alias("n"))
    rules = Catalogue().table(spark)
    return rules.join(found, rules.rule_id == found.rule, "left").select(
        "rule_id", "label", "category", "tier", "multiline", "entropy", F.coalesce("n", F.lit(0)).alias("n_findings")
    )


# ---- detectors on the documents ----


def _span_columns(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "value"
    )


def _detector(name: str, category: str, source: str) -> None:
    sql = (
        f"WITH RECURSIVE {expected.document_spans((source,))} "
        'SELECT id AS doc_id, s AS start, e AS "end", value FROM spans'
    )
    job(name, sql)(lambda spark, sf_dir: _span_columns(document_scan(spark, sf_dir, [category]).occurrences))


_detector("emails", "email", "emails")
_detector("ipv4", "ip", "ips")
_detector("cards", "card", "cards")
_detector("phones", "phone", "phones")


_LONG_DOMAIN = "'far.off@' || repeat('x1.', 260) || 'example.com'"


@job(
    "emails_long",
    "WITH RECURSIVE " + expected.document_spans(("emails",))
    + f"""SELECT id AS doc_id, s AS start, value FROM spans
      UNION ALL SELECT doc_id, length(text) + 6 AS start, {_LONG_DOMAIN} AS value FROM documents WHERE text IS NOT NULL""",
)
def emails_long(spark, sf_dir):
    """Every text with an address of 262 labels behind it: addresses have no longest domain."""
    docs = documents(spark, sf_dir).withColumn("text", F.expr(f"text || ' mail ' || {_LONG_DOMAIN} || ', thanks'"))
    found = scan(docs, "text", ["doc_id"], ["email"]).occurrences
    return found.select("doc_id", F.col("start").cast("bigint").alias("start"), "value")


@job("scan_ip_only", expected.findings(("ips",)) + 'SELECT id AS doc_id, s AS start, e AS "end", category, rule, placeholder FROM findings')
def scan_ip_only(spark, sf_dir):
    return _finding_columns(document_scan(spark, sf_dir, ["ip"]).findings)


def _finding_columns(df: DataFrame, key: str = "doc_id") -> DataFrame:
    return df.select(
        key, F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"),
        "category", "rule", "placeholder",
    )


@job(
    "match_offsets",
    "WITH RECURSIVE " + expected.steps("tokens") + " SELECT id AS doc_id, s AS start, s + length(value) AS \"end\", value AS match FROM tokens_hits",
)
def match_offsets(spark, sf_dir):
    """Offsets of all inline quoted pairs."""
    pattern = r"(?<![\w.-])[A-Za-z_][\w.-]*[ \t]*=[ \t]*\"[^\"\n]*\""
    return (
        documents(spark, sf_dir)
        .select("doc_id", F.explode_outer(find_all(searchable(F.col("text")), pattern)).alias("m"))
        .where(F.col("m").isNotNull())
        .select("doc_id", F.col("m.start").cast("bigint").alias("start"), F.col("m.end").cast("bigint").alias("end"), F.col("m.match").alias("match"))
    )


@job(
    "cards_valid",
    "WITH RECURSIVE " + expected.steps("cards") + f" SELECT id AS doc_id, s AS start, value, coalesce({expected.CARD_OK}, false) AS valid FROM cards_hits",
)
def cards_valid(spark, sf_dir):
    """Every card-shaped number with the verdict of issuer, length and Luhn."""
    return (
        documents(spark, sf_dir)
        .select("doc_id", F.explode_outer(find_all(searchable(F.col("text")), P.CARD)).alias("m"))
        .where(F.col("m").isNotNull())
        .select("doc_id", F.col("m.start").cast("bigint").alias("start"), F.col("m.match").alias("value"), checks.card_valid(F.col("m.match")).alias("valid"))
    )


@job(
    "ipv4_public",
    "WITH RECURSIVE " + expected.steps("ips") + f" SELECT id AS doc_id, s AS start, value, {expected.IP_OK} AS public FROM ips_hits",
)
def ipv4_public(spark, sf_dir):
    return (
        documents(spark, sf_dir)
        .select("doc_id", F.explode_outer(find_all(searchable(F.col("text")), P.IPV4)).alias("m"))
        .where(F.col("m").isNotNull())
        .select("doc_id", F.col("m.start").cast("bigint").alias("start"), F.col("m.match").alias("value"),
                checks.ipv4_public(F.col("m.match"), F.col("m.before")).alias("public"))
    )


_GENERIC = (
    "SELECT id AS doc_id, s AS start, e AS \"end\", 'keys' AS category, 'API_KEY' AS label, 'generic-api-key' AS rule "
    f"FROM spans WHERE rule = 'env-secret' AND length(value) >= 10 AND {derived.SQL_ENTROPY.format(v='value')} > 3.5"
)
_CANDIDATES = (
    "WITH RECURSIVE " + expected.document_spans()
    + ', found AS (SELECT id AS doc_id, s AS start, e AS "end", category, label, rule FROM spans UNION ALL ' + _GENERIC + ")"
)


@job("candidates", _CANDIDATES + " SELECT * FROM found")
def all_candidates(spark, sf_dir):
    return candidates(documents(spark, sf_dir), "text", ["doc_id"]).select(
        "doc_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "category", "label", "rule"
    )


# ---- detectors on the derived logs ----

_LOG = "WITH " + derived.sql_service_log()


def _log_detector(name: str, categories: list[str], rules: tuple[str, ...]) -> None:
    listed = ", ".join(_text(r) for r in rules)
    sql = _LOG + f'SELECT log_id, start, "end", rule, value FROM log_findings WHERE rule IN ({listed})'

    def run(spark, sf_dir):
        found = log_scan(spark, sf_dir, categories).occurrences.where(F.col("rule").isin(*rules))
        return found.select(
            "log_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "rule", "value"
        )

    job(name, sql)(run)


_SECRETS = ["keys", "privateKeys", "passwords"]
_log_detector("auth_headers", _SECRETS, ("bearer_token", "basic_auth"))
_log_detector("url_credentials", _SECRETS, ("db_password", "password"))
_log_detector("named_secrets", _SECRETS, ("env-secret",))
_log_detector("high_entropy", _SECRETS, ("high-entropy",))
_log_detector("private_keys", ["privateKeys"], ("private-key",))
_log_detector("multiline_secrets", _SECRETS, ("curl-auth-user", "kubernetes-secret-yaml", "private-key"))
_log_detector(
    "rule_findings", _SECRETS,
    ("aws-access-token", "github-pat", "gitlab-pat", "npm-access-token", "stripe-access-token", "twilio-api-key",
     "digitalocean-pat", "datadog-access-token", "sonar-api-token", "heroku-api-key"),
)
_log_detector("ibans", ["iban"], ("iban",))


@job("ipv6", _LOG + "SELECT log_id, start, \"end\", value FROM log_findings WHERE rule = 'ip' AND contains(value, ':')")
def ipv6(spark, sf_dir):
    found = log_scan(spark, sf_dir, ["ip"]).occurrences.where(F.contains("value", F.lit(":")))
    return found.select("log_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "value")


@job("log_findings", _LOG + 'SELECT log_id, start, "end", category, rule, placeholder FROM log_findings')
def log_findings(spark, sf_dir):
    """All detectors at once over the derived logs."""
    return _finding_columns(log_scan(spark, sf_dir).findings, "log_id")


# one text per customer and shape; the shape decides whether the pair counts
_PAIR_KEYS = (
    "'DB_PASSWORD'", "'apiKey'", "'client-secret'", "'publicKey'", "'request_id'", "'monkey'", "'user.pwd'", "'title'",
    "'STRIPE_PUBLISHABLE_KEY'", "'authToken'", "'compass'", "'PASS'",
)


@job(
    "secret_key_names",
    f"""WITH keys AS (SELECT c_custkey, unnest([{', '.join(f"{k} || '_' || c_custkey" for k in _PAIR_KEYS)}, {', '.join(_PAIR_KEYS)}]) AS key FROM customer),
    seg AS (SELECT c_custkey, key, string_split(regexp_replace(regexp_replace(key, '([a-z0-9])([A-Z])', '\\1.\\2', 'g'), '[_-]', '.', 'g'), '.') AS parts FROM keys)
    SELECT c_custkey, key, NOT regexp_matches(upper(key), 'PUBLIC|PUBLISHABLE') AND (
      regexp_matches(upper(key), 'PASSWORD|PASSWD|PASSPHRASE|SECRET|TOKEN|PRIVATE|CREDENTIAL')
      OR len(list_filter(parts, lambda p: regexp_full_match(upper(p), '[A-Z]*KEYS?|PASS|PWD'))) > 0) AS secret FROM seg""",
)
def secret_key_names(spark, sf_dir):
    both = ", ".join([*(f"{k} || '_' || c_custkey" for k in _PAIR_KEYS), *_PAIR_KEYS])
    keys = derived.customers(spark, sf_dir, "c_custkey").select("c_custkey", F.explode(F.expr(f"array({both})")).alias("key"))
    return keys.select("c_custkey", "key", checks.is_secret_name(F.col("key")).alias("secret"))


_VALUES = (
    "'***'", "'xxxx'", "'...'", "'<' || c_name || '>'", "'[' || c_name || ']'", "'${' || c_mktsegment || '}'",
    "'%' || c_mktsegment || '%'", "'{{ ' || c_name || ' }}'", "'Changeme'", "'NULL'", "'hunter_' || c_custkey", "c_name",
    "md5(c_name)", "'TOKEN_' || c_custkey", "'truethfully' || c_custkey", "'is null'", "'/etc/' || c_mktsegment",
)
_VALUE_ROWS = f"array({', '.join(_VALUES)})"


@job(
    "assign_not_value",
    f"""WITH vals AS (SELECT c_custkey, unnest([{', '.join(_VALUES)}]) AS value FROM customer)
    SELECT c_custkey, value, regexp_full_match(value, '(?i)(?:\\*+|x+|\\.\\.\\.|<[^>]*>|\\[[^\\]]*\\]|\\$\\{{?[\\w.]+\\}}?|%\\w+%|\\{{\\{{.*\\}}\\}}|null|nil|none|undefined|true|false|yes|no|on|off|changeme|redacted|[A-Z0-9][A-Z0-9_]*_\\d+)') AS not_a_value FROM vals""",
)
def assign_not_value(spark, sf_dir):
    vals = derived.customers(spark, sf_dir, "c_custkey", "c_name", "c_mktsegment").select("c_custkey", F.explode(F.expr(_VALUE_ROWS)).alias("value"))
    return vals.select("c_custkey", "value", F.col("value").rlike(P.NOT_A_VALUE).alias("not_a_value"))


@job(
    "skip_placeholders",
    f"""WITH vals AS (SELECT c_custkey, unnest([{', '.join(_VALUES)}]) AS value FROM customer)
    SELECT c_custkey, value, regexp_full_match(value, '[A-Z0-9][A-Z0-9_]*_\\d+') AS placeholder FROM vals""",
)
def skip_placeholders(spark, sf_dir):
    vals = derived.customers(spark, sf_dir, "c_custkey", "c_name", "c_mktsegment").select("c_custkey", F.explode(F.expr(_VALUE_ROWS)).alias("value"))
    return vals.select("c_custkey", "value", checks.is_placeholder(F.col("value")).alias("placeholder"))


@job(
    "global_allowlist",
    f"""WITH vals AS (SELECT c_custkey, unnest([{', '.join(_VALUES)}]) AS value FROM customer)
    SELECT c_custkey, value, {' OR '.join("regexp_matches(value, " + _text(p) + ")" for p in P.GLOBAL_ALLOW)} AS allowed FROM vals""",
)
def global_allowlist(spark, sf_dir):
    vals = derived.customers(spark, sf_dir, "c_custkey", "c_name", "c_mktsegment").select("c_custkey", F.explode(F.expr(_VALUE_ROWS)).alias("value"))
    return vals.select("c_custkey", "value", checks.globally_allowed(F.col("value")).alias("allowed"))


# generic secrets in contexts that the rule's own lists accept or reject
_GENERIC_TEXTS = (
    ("'service auth: '", "('Zx' || translate(md5(c_name), 'abc', 'GHJ'))", True),
    ("'author: '", "('Zx' || translate(md5(c_name || '1'), 'abc', 'GHJ'))", False),
    ("'api_version: '", "('Zx' || translate(md5(c_name || '2'), 'abc', 'GHJ'))", False),
    ("'foreign_key: '", "('Zx' || translate(md5(c_name || '3'), 'abc', 'GHJ'))", False),
    ("'run --mount=type=secret,id=x creds: '", "('Zx' || translate(md5(c_name || '4'), 'abc', 'GHJ'))", False),
    ("'my creds => '", "('Zx' || translate(md5(c_name || '5'), 'abc', 'GHJ'))", True),
)


@job(
    "rule_allowlist",
    "WITH texts AS (SELECT c_custkey, unnest([" + ", ".join(f"{i}" for i in range(len(_GENERIC_TEXTS))) + "]) AS shape, unnest(["
    + ", ".join(v for _, v, _ in _GENERIC_TEXTS) + "]) AS value, unnest(["
    + ", ".join(f"length({b})" for b, _, _ in _GENERIC_TEXTS) + "]) AS start FROM customer) "
    + "SELECT c_custkey, shape, start, value FROM texts WHERE shape IN ("
    + ", ".join(str(i) for i, (_, _, ok) in enumerate(_GENERIC_TEXTS) if ok)
    + f") AND {derived.SQL_ENTROPY.format(v='value')} > 3.5",
)
def rule_allowlist(spark, sf_dir):
    shapes = ", ".join(f"struct({i} AS shape, {b} || {v} AS text)" for i, (b, v, _) in enumerate(_GENERIC_TEXTS))
    texts = derived.customers(spark, sf_dir, "c_custkey", "c_name").select("c_custkey", F.expr(f"inline(array({shapes}))"))
    found = candidates(texts, "text", ["c_custkey", "shape"], ["keys"]).where("rule = 'generic-api-key'")
    # Spark takes texts for as small as the table they are made of; both sides are exchanged, none is sent to the driver.
    return found.join(texts.hint("merge"), ["c_custkey", "shape"]).select(
        "c_custkey", "shape", "start", F.expr("substr(text, start + 1, `end` - start)").alias("value")
    )


@job(
    "every_rule",
    rule_samples.texts_sql("supplier", "s_suppkey")
    + f" SELECT s_suppkey, rule_id, start, value FROM shapes WHERE least < 0 OR {derived.SQL_ENTROPY.format(v='made')} > least",
)
def every_rule(spark, sf_dir):
    """The finding of each rule of the catalogue in a text made from its pattern, for every supplier."""
    # 221 texts of a line each
    suppliers = derived.spread(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey"), 30)
    texts = rule_samples.texts_of(suppliers, "s_suppkey")
    found = candidates(texts, "text", ["s_suppkey", "rule_id", "text"], ["keys", "passwords", "privateKeys"]).where("rule = rule_id")
    return found.select(
        "s_suppkey", "rule_id", F.col("start").cast("bigint").alias("start"), F.expr("substr(text, start + 1, `end` - start)").alias("value")
    )


# A generic value is no secret where it holds a stop word; here the stop words are the names of the nations.
_STOPWORD_VALUE = (
    "'Zx' || substr(md5(c_name), 1, 9) || CASE WHEN c_custkey % 3 = 0 THEN lower(replace(n_name, ' ', '')) "
    "WHEN c_custkey % 3 = 1 THEN replace(n_name, ' ', '9') ELSE 'Q7' END || substr(md5(c_name), 9, 9)"
)


@job(
    "rule_stopwords",
    f"""WITH vals AS (SELECT c_custkey, {_STOPWORD_VALUE} AS value FROM customer JOIN nation ON c_nationkey = n_nationkey)
    SELECT c_custkey, value, length('service auth: ') AS start FROM vals
    WHERE {derived.SQL_ENTROPY.format(v='value')} > 3.5
      AND NOT EXISTS (SELECT 1 FROM nation WHERE contains(lower(value), lower(n_name)))""",
)
def rule_stopwords(spark, sf_dir):
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    customers = derived.customers(spark, sf_dir, "c_custkey", "c_name", "c_nationkey").join(F.broadcast(nations), F.expr("c_nationkey = n_nationkey"))
    texts = customers.select("c_custkey", F.expr(f"'service auth: ' || {_STOPWORD_VALUE}").alias("text"))
    found = scan(texts, "text", ["c_custkey"], ["keys"], catalogue=Catalogue.with_words_of(nations, "n_name")).occurrences
    return found.where("rule = 'generic-api-key'").select("c_custkey", "value", F.col("start").cast("bigint").alias("start"))


_CODE_TEXTS = (
    ("'token = getToken'", "'token = getToken(' || c_custkey || ')'"),
    ("env", "'api_key = process.env.KEY_' || c_custkey"),
    ("idx", "'secret_key = os.environ[' || c_custkey || ']'"),
    ("lit", "'secret_key = ' || substr(md5(c_name), 1, 12)"),
    ("file", "'password = secrets.tar.gz' || c_custkey"),
)


@job(
    "assign_not_code",
    "SELECT c_custkey, 'secret_key' AS key, substr(md5(c_name), 1, 12) AS value FROM customer",
)
def assign_not_code(spark, sf_dir):
    """Pairs whose value is a literal; calls, indexes and dotted names are dropped."""
    texts = derived.customers(spark, sf_dir, "c_custkey", "c_name").select(
        "c_custkey", F.expr("explode(array(" + ", ".join(t for _, t in _CODE_TEXTS) + "))").alias("text")
    )
    kept = F.filter(assignments.pairs(searchable(F.col("text"))), lambda p: assignments.is_literal(p))
    return texts.select("c_custkey", F.explode(kept).alias("p")).select("c_custkey", "p.key", "p.value")


# the three forms of an assignment: text before the value, key, value, text after it
_FORM_PARTS = (
    ("""'export DB_SECRET="'""", "DB_SECRET", "md5(c_name)", """'"' || chr(10)""", "line"),
    ("'api.key: '", "api.key", "substr(md5(c_name), 1, 12)", "chr(10)", "line"),
    ("""'{"id": "'""", "id", "CAST(c_custkey AS STRING)", """'", '""", "json"),
    ("""'"client_secret": "'""", "client_secret", "c_name", """'"}' || chr(10)""", "json"),
    ("'done with mode='", "mode", "substr(md5(c_name), 3, 6)", "' and '", "inline"),
    ("'token=' || chr(39)", "token", "c_mktsegment", "chr(39) || ' for now' || chr(10)", "inline"),
    ("chr(9) || 'pass_phrase = '", "pass_phrase", "'two' || substr(md5(c_name), 5, 4)", "''", "line"),
)
_FORM_TEXT = " || ".join(f"{before} || {value} || {after}" for before, _, value, after, _ in _FORM_PARTS)


def _form_rows() -> str:
    rows, start = [], "0"
    for before, key, value, after, form in _FORM_PARTS:
        rows.append(
            f"SELECT c_custkey, '{key}' AS key, {value} AS value, CAST({start} + length({before}) AS BIGINT) AS start, "
            f"'{form}' AS form FROM customer"
        )
        start += f" + length({before} || {value} || {after})"
    return " UNION ALL ".join(rows)


@job("assignment_forms", _form_rows())
def assignment_forms(spark, sf_dir):
    """Whole lines, JSON members and inline pairs in one text."""
    texts = derived.customers(spark, sf_dir, "c_custkey", "c_name", "c_mktsegment").select("c_custkey", F.expr(_FORM_TEXT).alias("text"))
    found = texts.select("c_custkey", F.explode_outer(assignments.pairs(searchable(F.col("text")))).alias("p"))
    return found.where(F.col("p").isNotNull()).select(
        "c_custkey", "p.key", "p.value", F.col("p.start").cast("bigint").alias("start"), "p.form"
    )


@job(
    "assignments",
    "WITH RECURSIVE " + expected.steps("tokens")
    + r""" SELECT id AS doc_id, regexp_extract(value, '^[A-Za-z_][\w.-]*') AS key, regexp_extract(value, '"([^"\n]*)"$', 1) AS value,
      s + length(value) - 1 - length(regexp_extract(value, '"([^"\n]*)"$', 1)) AS start, 'inline' AS form FROM tokens_hits""",
)
def all_assignments(spark, sf_dir):
    return (
        documents(spark, sf_dir)
        .select("doc_id", F.explode_outer(assignments.pairs(searchable(F.col("text")))).alias("p"))
        .where(F.col("p").isNotNull())
        .select("doc_id", "p.key", "p.value", F.col("p.start").cast("bigint").alias("start"), "p.form")
    )


@job(
    "secrets_min_entropy",
    "WITH RECURSIVE " + expected.document_spans(("tokens",))
    + f" SELECT id AS doc_id, value, round({derived.SQL_ENTROPY.format(v='value')}, 6) AS bits, {derived.SQL_ENTROPY.format(v='value')} > 3.5 AS opaque FROM spans",
)
def secrets_min_entropy(spark, sf_dir):
    found = document_scan(spark, sf_dir, ["passwords"]).occurrences
    return found.select("doc_id", "value", F.round(entropy("value"), 6).alias("bits"), (entropy("value") > 3.5).alias("opaque"))


# valid IBANs and the same with a wrong check digit
_BAD_IBAN = f"('DE' || lpad(CAST((CAST({derived._IBAN_CHECK} AS INT) + 1) % 100 AS STRING), 2, '0') || {derived._BBAN})"


@job(
    "iban_valid",
    f"WITH ks AS (SELECT c_custkey, CAST(c_custkey AS STRING) AS k FROM customer) SELECT c_custkey, {derived.IBAN} AS iban, true AS valid FROM ks "
    f"UNION ALL SELECT c_custkey, {_BAD_IBAN} AS iban, false AS valid FROM ks",
)
def iban_valid(spark, sf_dir):
    ks = derived.customers(spark, sf_dir, "c_custkey").select("c_custkey", F.col("c_custkey").cast("string").alias("k"))
    both = ks.select("c_custkey", F.explode(F.expr(f"array({derived.IBAN}, {_BAD_IBAN})")).alias("iban"))
    return both.select("c_custkey", "iban", checks.iban_valid(F.col("iban")).alias("valid"))


_G = [f"substr(md5(c_name), {4 * i + 1}, 4)" for i in range(8)]
_IPV6_SHAPES = (
    (" || ':' || ".join(_G), True),
    (" || ':' || ".join(_G[:7]), False),
    (f"{_G[0]} || '::' || {_G[1]} || ':' || {_G[2]} || '1'", False),
    (f"{_G[0]} || '::' || {_G[1]}", False),
    (f"{_G[0]} || '::' || {_G[1]} || '::' || {_G[2]}", False),
    (f"'2001:db8::' || {_G[1]}", True),
    (f"'fe80::' || {_G[1]} || ':' || {_G[2]}", True),
    (f"'::' || {_G[1]} || ':' || {_G[2]}", False),
    (f"':' || {_G[1]} || ':' || {_G[2]} || ':' || {_G[3]}", False),
)


@job(
    "ipv6_valid",
    " UNION ALL ".join(
        f"SELECT c_custkey, {i} AS shape, {s} AS value, "
        + (f"{str(ok).lower()} AND regexp_matches({s}, '[0-9]')" if ok else "false") + " AS valid FROM customer"
        for i, (s, ok) in enumerate(_IPV6_SHAPES)
    ),
)
def ipv6_valid(spark, sf_dir):
    shapes = ", ".join(f"struct({i} AS shape, {s} AS value)" for i, (s, _) in enumerate(_IPV6_SHAPES))
    rows = derived.customers(spark, sf_dir, "c_custkey", "c_name").select("c_custkey", F.expr(f"inline(array({shapes}))"))
    return rows.select("c_custkey", "shape", "value", checks.ipv6_valid(F.col("value")).alias("valid"))


# ---- overlap resolution on spans derived from order lines ----

_SPAN_SQL = """
  SELECT l_orderkey AS doc, CAST(l_partkey % 40 AS INT) AS start, CAST(l_partkey % 40 + 1 + l_suppkey % 12 AS INT) AS "end",
         l_returnflag AS category, 'L' || l_linenumber AS label, CAST(1 + l_partkey % 3 AS INT) AS tier, l_linestatus AS rule,
         CAST(l_linenumber * 1000000 + l_partkey AS INT) AS seq, l_linenumber, l_extendedprice
  FROM lineitem
"""
_SPANS = f"""
  raw AS ({_SPAN_SQL}),
  cand AS (SELECT doc, start, "end", min(category) AS category, label, tier, rule, seq FROM raw
           GROUP BY doc, start, "end", label, tier, rule, seq)
"""
_RANKED = _SPANS + """,
  ranked AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY tier DESC, "end" - start DESC, start, seq) AS priority FROM cand)
"""
_ISLANDS = _SPANS + """,
  reach AS (SELECT *, max("end") OVER (PARTITION BY doc ORDER BY start, "end", seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM cand),
  islands AS (SELECT doc, start, "end", label, seq, CAST(sum(CASE WHEN r IS NULL OR start >= r THEN 1 ELSE 0 END)
                OVER (PARTITION BY doc ORDER BY start, "end", seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS island FROM reach)
"""
_RESOLVED = "WITH RECURSIVE " + _RANKED + """,
  greedy AS (
    SELECT DISTINCT doc, CAST(0 AS BIGINT) AS p, CAST([] AS STRUCT(s INT, e INT, q INT)[]) AS taken FROM cand
    UNION ALL
    SELECT g.doc, g.p + 1, CASE WHEN len(list_filter(g.taken, lambda t: t.s < c."end" AND c.start < t.e)) > 0 THEN g.taken
      ELSE list_append(g.taken, {'s': c.start, 'e': c."end", 'q': c.seq}) END
    FROM greedy g JOIN ranked c ON c.doc = g.doc AND c.priority = g.p + 1),
  last AS (SELECT doc, max_by(taken, p) AS taken FROM greedy GROUP BY doc),
  kept AS (SELECT doc, unnest(taken) AS t FROM last),
  resolved AS (SELECT cand.* FROM kept JOIN cand ON cand.doc = kept.doc AND cand.seq = kept.t.q AND cand.start = kept.t.s AND cand."end" = kept.t.e)
"""


def line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr(
        "l_orderkey AS doc", "CAST(l_partkey % 40 AS INT) AS start",
        "CAST(l_partkey % 40 + 1 + l_suppkey % 12 AS INT) AS `end`", "l_returnflag AS category",
        "'L' || l_linenumber AS label", "CAST(1 + l_partkey % 3 AS INT) AS tier", "l_linestatus AS rule",
        "CAST(l_linenumber * 1000000 + l_partkey AS INT) AS seq",
    )
    return raw.groupBy("doc", "start", "end", "label", "tier", "rule", "seq").agg(F.min("category").alias("category"))


@job("candidate_priority", "WITH " + _RANKED + ' SELECT doc, start, "end", tier, seq, priority FROM ranked')
def candidate_priority(spark, sf_dir):
    return resolve.priority(line_spans(spark, sf_dir), ["doc"]).select(
        "doc", "start", "end", "tier", "seq", F.col("priority").cast("bigint").alias("priority")
    )


@job("overlap_islands", "WITH " + _ISLANDS + ' SELECT doc, start, "end", seq, island FROM islands')
def overlap_islands(spark, sf_dir):
    return resolve.overlap_islands(line_spans(spark, sf_dir), ["doc"]).select("doc", "start", "end", "seq", "island")


@job(
    "overlapping_candidates",
    "WITH " + _ISLANDS + """ SELECT a.doc, a.start, a."end", a.seq, count(*) AS n_overlaps FROM islands a JOIN islands b
      ON a.doc = b.doc AND b.start < a."end" AND a.start < b."end" AND (b.start, b."end", b.seq) < (a.start, a."end", a.seq)
      GROUP BY ALL""",
)
def overlapping_candidates(spark, sf_dir):
    return resolve.overlapping_pairs(line_spans(spark, sf_dir), ["doc"]).select(
        "doc", "start", "end", "seq", F.col("n_overlaps").cast("bigint").alias("n_overlaps")
    )


@job("resolved_spans", _RESOLVED + ' SELECT doc, start, "end", label, tier FROM resolved')
def resolved_spans(spark, sf_dir):
    return resolve.resolved_table(line_spans(spark, sf_dir), ["doc"]).select("doc", "start", "end", "label", "tier")


@job(
    "merged_spans",
    _RESOLVED + """,
  marked AS (SELECT *, CASE WHEN lag("end") OVER (PARTITION BY doc ORDER BY start) = start THEN 0 ELSE 1 END AS head FROM resolved),
  grouped AS (SELECT *, sum(head) OVER (PARTITION BY doc ORDER BY start ROWS UNBOUNDED PRECEDING) AS g FROM marked)
  SELECT doc, min(start) AS start, max("end") AS "end", arg_min(label, start - 100000 * tier) AS label, max(tier) AS tier FROM grouped GROUP BY doc, g""",
)
def merged_spans(spark, sf_dir):
    spans = resolve.resolved_table(line_spans(spark, sf_dir), ["doc"])
    return resolve.merged_table(spans, ["doc"]).select("doc", "start", "end", "label", "tier")


# ---- masking, maps, restoring ----

_FINDINGS = expected.findings()


@job("findings", _FINDINGS + 'SELECT id AS doc_id, s AS start, e AS "end", category, rule, placeholder FROM findings')
def all_findings(spark, sf_dir):
    return _finding_columns(document_scan(spark, sf_dir).findings)


@job("mask_documents", _FINDINGS.rstrip() + "," + expected.MASKED + "SELECT doc_id, masked FROM masked")
def mask_documents(spark, sf_dir):
    return document_scan(spark, sf_dir).masked


@job("placeholder_map", _FINDINGS + "SELECT id AS doc_id, placeholder, value FROM names")
def placeholder_map(spark, sf_dir):
    return document_scan(spark, sf_dir).map


@job(
    "unique_values",
    _FINDINGS + "SELECT id AS doc_id, value, label, CAST(count(*) AS BIGINT) AS n_matches, min(s) AS first_start FROM findings GROUP BY id, value, label",
)
def unique_values(spark, sf_dir):
    found = document_scan(spark, sf_dir).occurrences
    return naming.unique_values(found, "doc_id", ["start"]).select(
        "doc_id", "value", "label", "n_matches", F.col("first.start").cast("bigint").alias("first_start")
    )


@job(
    "source_map",
    "WITH RECURSIVE " + expected.document_spans() + """,
  firsts AS (SELECT d.source, value, min((s.id, s.s)) AS first_seen, arg_min(label, (s.id, s.s)) AS label
             FROM spans s JOIN documents d ON d.doc_id = s.id GROUP BY d.source, value)
  SELECT source, value, label || '_' || row_number() OVER (PARTITION BY source, label ORDER BY first_seen) AS placeholder FROM firsts""",
)
def source_map(spark, sf_dir):
    """One map per source: equal values share a placeholder across its documents."""
    docs = read_documents(spark, f"{sf_dir}/documents.parquet", ["source", "doc_id"])
    return scan(docs, "text", ["source", "doc_id"], scope="source", order=["doc_id"]).map.select("source", "value", "placeholder")


@job(
    "source_masked",
    "WITH RECURSIVE " + expected.document_spans() + """,
  firsts AS (SELECT d.source, value, min((s.id, s.s)) AS first_seen, arg_min(label, (s.id, s.s)) AS label
             FROM spans s JOIN documents d ON d.doc_id = s.id GROUP BY d.source, value),
  issued AS (SELECT source, value, label || '_' || row_number() OVER (PARTITION BY source, label ORDER BY first_seen) AS placeholder FROM firsts),
  findings AS (SELECT s.id, s.s, s.e, i.placeholder FROM spans s JOIN documents d ON d.doc_id = s.id
               JOIN issued i ON i.source = d.source AND i.value = s.value),
""" + expected.MASKED + " SELECT doc_id, masked FROM masked",
)
def source_masked(spark, sf_dir):
    docs = read_documents(spark, f"{sf_dir}/documents.parquet", ["source", "doc_id"])
    return scan(docs, "text", ["source", "doc_id"], scope="source", order=["doc_id"]).masked.select("doc_id", "masked")


@job(
    "conversation_masked",
    """WITH named AS (SELECT conv_id, turn % 3 AS who, row_number() OVER (PARTITION BY conv_id ORDER BY min(turn)) AS n
                     FROM conversations WHERE text IS NOT NULL GROUP BY conv_id, turn % 3)
  SELECT c.conv_id, c.turn, c.text || ' write to EMAIL_' || named.n || ' now' AS masked
  FROM conversations c LEFT JOIN named ON named.conv_id = c.conv_id AND named.who = c.turn % 3""",
)
def conversation_masked(spark, sf_dir):
    """Conversations numbered as one scope per conversation; every turn gets one of three addresses behind it."""
    turns = read_documents(spark, f"{sf_dir}/conversations.parquet", ["conv_id", "turn"]).withColumn(
        "text", F.expr("text || ' write to someone' || (turn % 3) || '@mail.example.org now'")
    )
    return scan(turns, "text", ["conv_id", "turn"], scope="conv_id", order=["turn"]).masked


@job(
    "mask_pages",
    expected.findings(("emails", "ips", "cards", "phones"), "pages", "page_id", "html")
    + 'SELECT id AS page_id, s AS start, e AS "end", category, rule, placeholder FROM findings',
)
def mask_pages(spark, sf_dir):
    """Findings in raw web pages."""
    pages = read_documents(spark, f"{sf_dir}/pages.parquet", ["page_id"], "html")
    return _finding_columns(scan(pages, "html", ["page_id"]).findings, "page_id")


_RESERVED_PREFIX = "EMAIL_1 IP_2 CARD_03 CARD_3 MY_PHONE_1 PHONE_99999999999999999999 SECRET_1x "


@job(
    "reserved_placeholders",
    expected.findings()
    + """SELECT id AS doc_id, value, label || '_' || CASE
        WHEN label = 'EMAIL' THEN n + 1 WHEN label = 'IP' AND n >= 2 THEN n + 1 WHEN label = 'CARD' AND n >= 3 THEN n + 1 ELSE n END AS placeholder
      FROM (SELECT id, value, label, row_number() OVER (PARTITION BY id, label ORDER BY first_s) AS n FROM firsts)""",
)
def reserved_placeholders(spark, sf_dir):
    """Texts that already hold placeholder words: their numbers are not issued again."""
    docs = documents(spark, sf_dir).withColumn("text", F.concat(F.lit(_RESERVED_PREFIX), "text"))
    return scan(docs, "text", ["doc_id"]).map.select("doc_id", "value", "placeholder")


@job(
    "existing_placeholders",
    _FINDINGS + "SELECT DISTINCT id AS doc_id, placeholder FROM findings",
)
def existing_placeholders(spark, sf_dir):
    """Placeholder words of the masked documents."""
    masked = document_scan(spark, sf_dir).masked
    return (
        masked.select("doc_id", F.explode_outer(naming.existing_placeholders(F.col("masked"))).alias("placeholder"))
        .where(F.col("placeholder").isNotNull())
    )


@job(
    "restore_tokens",
    _FINDINGS + "SELECT id AS doc_id, row_number() OVER (PARTITION BY id ORDER BY s) - 1 AS place, placeholder AS word, value FROM findings",
)
def restore_tokens(spark, sf_dir):
    result = document_scan(spark, sf_dir).kept()
    names = result.map.withColumnRenamed("placeholder", "word")
    words = tokens(result.masked, "masked", ["doc_id"], "doc_id")
    return words.join(names, ["doc_id", "word"], "left").select(
        "doc_id", F.col("place").cast("bigint").alias("place"), "word", F.coalesce("value", "word").alias("value")
    )


@job("restore_documents", "SELECT doc_id, text AS restored FROM documents")
def restore_documents(spark, sf_dir):
    result = document_scan(spark, sf_dir).kept()
    return restore(result.masked, "masked", result.map, ["doc_id"], "doc_id").select("doc_id", "restored")


@job(
    "mask_segments",
    _FINDINGS.rstrip() + """,
  parts AS (
    SELECT f.id, f.s AS pos, f.value AS original, f.placeholder AS shown, f.placeholder FROM findings f
    UNION ALL
    SELECT f.id, prev_e, substr(d.text, prev_e + 1, f.s - prev_e), substr(d.text, prev_e + 1, f.s - prev_e), NULL
    FROM (SELECT *, coalesce(lag(e) OVER (PARTITION BY id ORDER BY s), 0) AS prev_e FROM findings) f JOIN documents d ON d.doc_id = f.id
    UNION ALL
    SELECT d.doc_id, coalesce(l.e, 0), substr(d.text, coalesce(l.e, 0) + 1), substr(d.text, coalesce(l.e, 0) + 1), NULL
    FROM documents d LEFT JOIN (SELECT id, max(e) AS e FROM findings GROUP BY id) l ON l.id = d.doc_id)
  SELECT id AS doc_id, row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS part, original, shown, placeholder FROM parts WHERE original <> ''""",
)
def mask_segments(spark, sf_dir):
    return document_scan(spark, sf_dir).segments.withColumn("part", F.col("part").cast("bigint"))


@job("stream_mask", _FINDINGS.rstrip() + "," + expected.MASKED + "SELECT doc_id, masked FROM masked")
def stream_mask(spark, sf_dir):
    """The documents as a stream into the sink with commit marks, read back from its finished batches."""
    folder = new_folder(spark)
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    stream = (
        spark.readStream.schema(schema).option("pathGlobFilter", "documents.parquet").parquet(sf_dir).select("doc_id", "text")
    )
    write_masked(
        stream, "text", ["doc_id"], f"{folder}/masked", f"{folder}/progress", f"{folder}/vault", findings_path=f"{folder}/findings"
    ).awaitTermination()
    return read_committed(spark, f"{folder}/masked", f"{folder}/masked", "doc_id BIGINT, masked STRING").drop("batch")


# ---- sinks, read back ----


def _written(spark, sf_dir):
    """Masked texts and findings by source and language, and the vault, written and read again."""
    folder = new_folder(spark)
    docs = read_documents(spark, f"{sf_dir}/documents.parquet", ("doc_id", "source", "lang"))
    write_scan(
        scan(docs, "text", ["doc_id", "source", "lang"]), f"{folder}/masked", f"{folder}/findings", f"{folder}/vault",
        partition_by=["source", "lang"],
    )
    return [spark.read.parquet(f"{folder}/{name}") for name in ("masked", "findings", "vault")]


@job(
    "sink_masked",
    _FINDINGS.rstrip() + "," + expected.MASKED
    + "SELECT m.doc_id, d.source, d.lang, m.masked FROM masked m JOIN documents d ON d.doc_id = m.doc_id",
)
def sink_masked(spark, sf_dir):
    return _written(spark, sf_dir)[0].select("doc_id", "source", "lang", "masked")


@job(
    "sink_tables",
    _FINDINGS + 'SELECT f.id AS doc_id, d.source, f.s AS start, f.category, f.placeholder, f.value '
    "FROM findings f JOIN documents d ON d.doc_id = f.id",
)
def sink_tables(spark, sf_dir):
    """The findings with the values that the vault has for them."""
    _, found, vault = _written(spark, sf_dir)
    return found.join(vault, ["doc_id", "source", "lang", "placeholder"]).select(
        "doc_id", "source", F.col("start").cast("bigint").alias("start"), "category", "placeholder", "value"
    )


# ---- SQL ----


@job(
    "sql_restore",
    "SELECT doc_id, 'Dear ' || source || ', see ' || lang || '; MY_N_7X and UNKNOWN_1 stay' AS restored FROM documents",
)
def sql_restore(spark, sf_dir):
    """The SQL form of restore, on replies that name things of their row."""
    sql.register(spark)
    spark.read.parquet(f"{sf_dir}/documents.parquet").createOrReplaceTempView("veilspark_documents")
    return spark.sql(
        "SELECT doc_id, restore('Dear SOURCE_' || doc_id || ', see N_7; MY_N_7X and UNKNOWN_1 stay', "
        "map('SOURCE_' || doc_id, source, 'N_7', lang)) AS restored FROM veilspark_documents"
    )


@job(
    "sql_categories",
    _FINDINGS + "SELECT position, c.category, count(f.id) AS n_findings FROM (VALUES "
    + ", ".join(f"({i}, '{c}')" for i, c in enumerate(P.CATEGORIES))
    + ") c(position, category) LEFT JOIN findings f ON f.category = c.category GROUP BY ALL",
)
def sql_categories(spark, sf_dir):
    """The findings of a scan by the categories, all in SQL."""
    sql.register(spark)
    document_scan(spark, sf_dir).create_views()
    return spark.sql(
        "SELECT position, c.category, count(f.doc_id) AS n_findings FROM categories c LEFT JOIN findings f "
        "ON f.category = c.category GROUP BY position, c.category"
    )


# ---- reports ----

_CATEGORY_LIST = ", ".join(f"({i}, '{c}')" for i, c in enumerate(P.CATEGORIES))
_HITS = "hits AS (SELECT id, placeholder, min(category) AS category, min(rule) AS rule, count(*) AS n_hits, min(s) AS first_start FROM findings GROUP BY id, placeholder)"


@job(
    "category_counts",
    _FINDINGS.rstrip() + f""", {_HITS}, cats(position, category) AS (VALUES {_CATEGORY_LIST})
  SELECT position, cats.category, count(placeholder) AS n_values, CAST(coalesce(sum(n_hits), 0) AS BIGINT) AS n_matches
  FROM cats LEFT JOIN hits ON hits.category = cats.category GROUP BY position, cats.category""",
)
def category_counts(spark, sf_dir):
    return reports.table_category_counts(document_scan(spark, sf_dir).rows)


@job(
    "doc_category_counts",
    _FINDINGS.rstrip() + f""", {_HITS}, cats(position, category) AS (VALUES {_CATEGORY_LIST})
  SELECT d.doc_id, position, cats.category, count(placeholder) AS n_values, CAST(coalesce(sum(n_hits), 0) AS BIGINT) AS n_matches
  FROM documents d CROSS JOIN cats LEFT JOIN hits ON hits.id = d.doc_id AND hits.category = cats.category
  GROUP BY d.doc_id, position, cats.category""",
)
def doc_category_counts(spark, sf_dir):
    """Unique values and matches of every document in each of the eight categories."""
    return reports.document_category_counts(document_scan(spark, sf_dir).rows, ["doc_id"])


@job(
    "category_counts_by_source",
    _FINDINGS.rstrip() + f""", {_HITS}
  SELECT category, lang, source, count(*) AS n_values, CAST(sum(n_hits) AS BIGINT) AS n_matches
  FROM hits JOIN documents d ON d.doc_id = hits.id GROUP BY ROLLUP (category, lang, source)""",
)
def category_counts_by_source(spark, sf_dir):
    docs = read_documents(spark, f"{sf_dir}/documents.parquet", ["doc_id", "lang", "source"])
    found = scan(docs, "text", ["doc_id", "lang", "source"]).findings
    return reports.counts_by(found, ["doc_id"], ["lang", "source"])


@job("placeholder_hits", _FINDINGS.rstrip() + f", {_HITS} SELECT id AS doc_id, placeholder, n_hits, first_start, category, rule FROM hits")
def placeholder_hits(spark, sf_dir):
    hits = reports.placeholder_hits(document_scan(spark, sf_dir).findings, ["doc_id"])
    return hits.withColumn("first_start", F.col("first_start").cast("bigint"))


@job(
    "scan_totals",
    _FINDINGS + "SELECT id AS doc_id, count(DISTINCT placeholder) AS n_values, count(*) AS n_matches FROM findings GROUP BY id",
)
def scan_totals(spark, sf_dir):
    totals = reports.scan_totals(document_scan(spark, sf_dir).rows, ["doc_id"])
    return totals.select("doc_id", F.col("n_values").cast("bigint").alias("n_values"), F.col("n_matches").cast("bigint").alias("n_matches"))


_SIZE = (
    "CASE WHEN {n} < 1024 THEN {n} || ' B' WHEN {n} < 1048576 THEN printf('%.1f', floor({n} * 10 / 1024 + 0.5) / 10) || ' KB' "
    "ELSE printf('%.1f', floor({n} * 10 / 1048576 + 0.5) / 10) || ' MB' END"
)


@job(
    "doc_stats",
    f"""WITH m AS (SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + 1 END AS n_lines, strlen(text) AS n_bytes FROM documents)
    SELECT doc_id, n_lines, n_bytes, format('{{:,}}', n_lines) || CASE WHEN n_lines = 1 THEN ' line' ELSE ' lines' END AS lines_text,
           {_SIZE.format(n='n_bytes')} AS size_text FROM m""",
)
def doc_stats(spark, sf_dir):
    stats = reports.document_stats(documents(spark, sf_dir), "text", ["doc_id"])
    return stats.withColumn("n_lines", F.col("n_lines").cast("bigint")).withColumn("n_bytes", F.col("n_bytes").cast("bigint"))


@job(
    "big_documents",
    "SELECT doc_id, length(text) > 307200 OR (length(text) - length(replace(text, chr(10), '')) + 1) > 5000 AS big FROM documents",
)
def big_documents(spark, sf_dir):
    return documents(spark, sf_dir).select("doc_id", reports.is_big(F.col("text")).alias("big"))


@job(
    "doc_entropy",
    "WITH chars AS (SELECT doc_id, unnest(string_split(text, '')) AS c, length(text) AS n FROM documents WHERE text <> ''), "
    "counts AS (SELECT doc_id, n, c, count(*) AS k FROM chars GROUP BY ALL) "
    "SELECT doc_id, round(-sum(k / n * log2(k / n)), 6) AS bits FROM counts GROUP BY doc_id "
    "UNION ALL SELECT doc_id, 0.0 FROM documents WHERE text = ''",
)
def doc_entropy(spark, sf_dir):
    """The SQL form of the entropy function."""
    spark.sql(ENTROPY_SQL)
    documents(spark, sf_dir).createOrReplaceTempView("veilspark_documents")
    return spark.sql("SELECT doc_id, round(entropy(text), 6) AS bits FROM veilspark_documents")


_NOUN = "CASE category " + " ".join(
    f"WHEN '{c}' THEN CASE WHEN n = 1 THEN '{one}' ELSE '{many}' END" for c, (one, many) in reports.NOUNS.items()
) + " END"


@job(
    "share_summary",
    _FINDINGS.rstrip() + f""", {_HITS}, cats(position, category) AS (VALUES {_CATEGORY_LIST}),
  counts AS (SELECT id, position, hits.category, count(*) AS n FROM hits JOIN cats ON cats.category = hits.category GROUP BY ALL),
  parts AS (SELECT id, list(n || ' ' || {_NOUN} ORDER BY position) AS p FROM counts GROUP BY id)
  SELECT id AS doc_id, CASE WHEN len(p) = 1 THEN p[1] ELSE array_to_string(p[1:len(p) - 1], ', ') || ' and ' || p[len(p)] END AS summary FROM parts""",
)
def share_summary(spark, sf_dir):
    return reports.share_summary(document_scan(spark, sf_dir).rows, ["doc_id"])


_PREVIEW = "CASE WHEN length(split_part(value, chr(10), 1)) > 64 THEN substr(split_part(value, chr(10), 1), 1, 61) || '...' ELSE split_part(value, chr(10), 1) || CASE WHEN contains(value, chr(10)) THEN ' ...' ELSE '' END END"


_REVIEW = f"SELECT log_id, category, placeholder, {_PREVIEW} AS preview, CAST(1 AS BIGINT) AS n_hits, rule FROM log_findings"


@job("review_rows", _LOG + _REVIEW)
def review_rows(spark, sf_dir):
    """Review rows of the derived logs, with one-line previews of the values."""
    return reports.review_rows(log_scan(spark, sf_dir).occurrences, ["log_id"])


@job("finding_rows", _LOG + _REVIEW)
def finding_rows(spark, sf_dir):
    """The same from a findings table and a map table."""
    result = log_scan(spark, sf_dir).kept()
    return reports.finding_rows(result.findings, result.map, ["log_id"])


# 230 addresses behind every text, the first of them twice: more than a list holds
_MANY = "array_join(transform(sequence(1, 230), i -> concat('box', i, '@many.example.org')), ', ')"


@job(
    "doc_top_findings",
    "WITH RECURSIVE " + expected.document_spans(("emails",))
    + """, many AS (SELECT doc_id AS id, 1000000000 + i AS s, 'box' || i || '@many.example.org' AS value, CASE WHEN i = 1 THEN 2 ELSE 1 END AS n
             FROM documents, range(1, 231) r(i) WHERE text IS NOT NULL),
  own AS (SELECT id, min(s) AS s, value, count(*) AS n FROM spans GROUP BY id, value UNION ALL SELECT * FROM many),
  placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s) AS p, count(*) OVER (PARTITION BY id) AS c FROM own)
  SELECT id AS doc_id, 'email' AS category, p AS place, 'EMAIL_' || p AS placeholder, value AS preview, 'email' AS rule,
         CAST(n AS BIGINT) AS n_hits, c - 200 AS n_more FROM placed WHERE p <= 200""",
)
def doc_top_findings(spark, sf_dir):
    """The first 200 values of every document and category as they appear, and how many more there are."""
    # a text grows by 6 KB here, so the tasks follow the rows, not the splits of the file
    rows = derived.spread(documents(spark, sf_dir).select("doc_id", "text"), texts_per_row=4)
    docs = rows.withColumn("text", F.expr(f"concat(text, ' ', {_MANY}, ' box1@many.example.org')"))
    top = reports.document_top_values(scan(docs, "text", ["doc_id"], ["email"]).rows, ["doc_id"])
    return top.select(*[F.col(c).cast("bigint").alias(c) if t == "int" else F.col(c) for c, t in top.dtypes])


@job(
    "top_findings",
    _FINDINGS.rstrip() + f""", by_value AS (SELECT category, value, count(*) AS n_hits, count(DISTINCT id) AS n_documents FROM findings GROUP BY category, value),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY n_hits DESC, value) AS place,
             greatest(count(*) OVER (PARTITION BY category) - 200, 0) AS n_more FROM by_value)
  SELECT category, value, n_hits, place, n_more FROM ranked WHERE place <= 200""",
)
def top_findings(spark, sf_dir):
    """The 200 most frequent values of every category and how many more there are."""
    found = document_scan(spark, sf_dir).kept().occurrences
    by_value = found.groupBy("category", "value").agg(F.count("*").alias("n_hits"))
    top = reports.top_rows(by_value, [F.desc("n_hits"), F.col("value")])
    return top.withColumn("place", F.col("place").cast("bigint"))


# ---- audits ----


@job(
    "leak_audit",
    _FINDINGS.rstrip() + "," + expected.MASKED + """,
  wanted AS (SELECT id AS doc_id, 'hide' AS must, value FROM names UNION ALL
             SELECT doc_id, unnest(['keep', 'hide']), split_part(text, ' ', 1) FROM documents UNION ALL
             SELECT id, 'keep', placeholder FROM names)
  SELECT w.doc_id, must, value FROM wanted w JOIN masked m ON m.doc_id = w.doc_id
  WHERE CASE WHEN must = 'hide' THEN contains(masked, value) ELSE NOT contains(masked, value) END""",
)
def leak_audit(spark, sf_dir):
    """Broken expectations: every value gone, the first word and every placeholder present.

    That the first word is gone is expected too, and wrongly, so the audit has something to find in every text.
    """
    word = F.substring_index("text", " ", 1).alias("value")
    more = F.array(F.struct(F.lit("keep").alias("must"), word), F.struct(F.lit("hide").alias("must"), word))
    return audits.leak_audit_in_rows(document_scan(spark, sf_dir), more)


@job("roundtrip_audit", "SELECT doc_id, true AS same FROM documents")
def roundtrip_audit(spark, sf_dir):
    return audits.roundtrip_in_rows(document_scan(spark, sf_dir))


@job(
    "rescan_audit",
    """SELECT 'email' AS category, 'email' AS rule, count(*) AS n_findings FROM documents HAVING count(*) > 0
    UNION ALL SELECT 'ip', 'ip', count(*) FROM documents WHERE doc_id % 2 = 0 HAVING count(*) > 0""",
)
def rescan_audit(spark, sf_dir):
    """A second scan of the masked documents finds what was left in them on purpose and nothing else."""
    left = F.expr("concat(masked, ' left.over@remains.example.org', if(doc_id % 2 = 0, ' at 203.0.113.77', ''))")
    return audits.rescan_audit(document_scan(spark, sf_dir).masked.withColumn("masked", left), ["doc_id"])


@job("log_roundtrip", _LOG + "SELECT log_id, true AS same FROM log_text")
def log_roundtrip(spark, sf_dir):
    result = log_scan(spark, sf_dir).kept()
    return audits.roundtrip_audit(
        derived.service_log(spark, sf_dir), result.masked, result.map, ["log_id"], "log_id"
    )
