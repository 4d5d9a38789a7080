"""Texts derived from the given tables, with findings known from the way they are built.

The documents of the test data hold emails, addresses, cards, phones and tokens
but no vendor keys, headers, key blocks or IBANs. Each customer row is therefore
turned into a log of several lines, whose values come from md5 of its key. The
same SQL fragments build the text in Spark and the expected findings in DuckDB,
so the expectation never runs a detector.

No value here looks like a real secret in the source: prefixes are split and
bodies are computed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Part:
    """One line of the log: text before the value, the value, text after it."""

    before: str
    value: str
    after: str
    category: str
    label: str
    rule: str
    min_entropy: float | None = None
    at_least: bool = False


def h(n: int) -> str:
    return f"md5(k || '-{n}')"


def _hex(n: int, length: int) -> str:
    if length <= 32:
        return f"substr({h(n)}, 1, {length})"
    return f"substr({h(n)} || {h(n + 500)} || {h(n + 700)}, 1, {length})"


def _luhn_digit(digits: str, length: int) -> str:
    """Check digit of a number of ``length`` digits."""
    terms = []
    for i in range(length):
        d = f"CAST(substr({digits}, {i + 1}, 1) AS INT)"
        doubled = (length - i) % 2 == 1
        terms.append(f"(CASE WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END)" if doubled else d)
    return f"CAST((10 - ({' + '.join(terms)}) % 10) % 10 AS STRING)"


_CARD_BASE = "('4' || lpad(k, 10, '2719') || '0731')"
CARD = f"({_CARD_BASE} || {_luhn_digit(_CARD_BASE, 15)})"
_BBAN = "lpad(k, 18, '370400440532013')"
_IBAN_CHECK = f"lpad(CAST(98 - CAST({_BBAN} || '131400' AS DECIMAL(38, 0)) % 97 AS STRING), 2, '0')"
IBAN = f"('DE' || {_IBAN_CHECK} || {_BBAN})"
IPV6 = f"('2001:db8:' || {_hex(31, 4)} || '::' || substr({h(32)}, 1, 4) || ':' || substr({h(33)}, 1, 4))"
UUID = (
    f"({_hex(40, 8)} || '-' || substr({h(41)}, 1, 4) || '-' || substr({h(42)}, 1, 4) || '-' || "
    f"substr({h(43)}, 1, 4) || '-' || {_hex(44, 12)})"
)
BEGIN, END = "'-----BEGIN RSA PRIV' || 'ATE KEY-----'", "'-----END RSA PRIV' || 'ATE KEY-----'"

LOG = (
    Part("'key id '", f"('AK' || 'IA' || translate(upper({_hex(1, 16)}), '0189', 'GHJK'))", "' loaded'",
         "keys", "AWS_ACCESS_KEY", "aws-access-token", 3.0),
    Part("'clone with '", f"('gh' || 'p_' || {_hex(2, 36)})", "''", "keys", "GITHUB_TOKEN", "github-pat", 3.0),
    Part("'use '", f"('gl' || 'pat-' || {_hex(3, 20)})", "' here'", "keys", "GITLAB_PAT", "gitlab-pat", 3.0),
    Part("'install with '", f"('np' || 'm_' || {_hex(4, 36)})", "' today'", "keys", "NPM_ACCESS_TOKEN",
         "npm-access-token", 2.0),
    Part("'charge by '", f"('sk' || '_live_' || {_hex(5, 24)})", "';'", "keys", "STRIPE_KEY",
         "stripe-access-token", 2.0),
    Part("'call '", f"('S' || 'K' || {_hex(6, 32)})", "''", "keys", "TWILIO_API_KEY", "twilio-api-key", 3.0),
    Part("'droplet '", f"('do' || 'p_v1_' || {_hex(7, 64)})", "''", "keys", "DIGITALOCEAN_PAT",
         "digitalocean-pat", 3.0),
    Part("'datadog_api_key = '", _hex(8, 40), "''", "keys", "DATADOG_ACCESS_TOKEN", "datadog-access-token"),
    Part("'sonar_token='", _hex(9, 40), "''", "keys", "SONAR_API_TOKEN", "sonar-api-token"),
    Part("'heroku id: '", UUID, "''", "keys", "HEROKU_API_KEY", "heroku-api-key"),
    Part("'Authorization: Bearer '", f"({h(10)} || '.' || {h(11)})", "''", "keys", "BEARER_TOKEN",
         "bearer_token", 3.0),
    Part("'DATABASE_URL=postgres://app:'", _hex(12, 12), "'@db.internal:5432/app'", "passwords", "DB_PASSWORD",
         "db_password"),
    Part("'mirror pulls from https://builder:'", _hex(13, 14), "'@code.example.org/shop/api.git'", "passwords",
         "PASSWORD", "password"),
    Part("'DB_PASSWORD='", _hex(14, 10), "''", "passwords", "PASSWORD", "env-secret"),
    Part("""'export SESSION_SECRET="'""", h(15), """'"'""", "passwords", "SECRET", "env-secret"),
    Part("""'{"issuer": "shop", "client_secret": "'""", h(16), """'"}'""", "passwords", "SECRET", "env-secret"),
    Part("'status=ok signature='", f"('Zq' || translate({h(17)}, '0123456789abcdef', 'GhJkMnPqRs012345'))", "' end'", "keys", "SECRET",
         "high-entropy", 3.7, True),
    Part("'contact user'", "k", "' left'", "", "", ""),
    Part("'mail '", "('user' || k || '@mail.example.com')", "' now'", "email", "EMAIL", "email"),
    Part("'client 10.'", "k", "'-x'", "", "", ""),
    Part("'peer '",
         "('10.' || CAST(c_custkey % 250 AS STRING) || '.' || CAST(c_custkey % 240 AS STRING) || '.7')", "' up'",
         "ip", "IP", "ip"),
    Part("'node '", IPV6, "' up'", "ip", "IP", "ip"),
    Part("'card '", CARD, "', thanks'", "card", "CARD", "card"),
    Part("'iban '", IBAN, "' booked'", "iban", "IBAN", "iban"),
    Part("'phone '", "('+44 20 7946 ' || lpad(CAST(c_custkey % 10000 AS STRING), 4, '0'))", "''", "phone", "PHONE",
         "phone"),
    Part("''", f"({BEGIN} || chr(10) || {_hex(20, 64)} || chr(10) || {_hex(21, 64)} || chr(10) || {END})", "''",
         "privateKeys", "PRIVATE_KEY", "private-key"),
    Part("'curl -u '", f"('admin:' || {_hex(22, 12)})", "' https://status.example.org/health'", "keys", "CURL_AUTH_USER",
         "curl-auth-user", 2.0),
    Part("'kind: Secret' || chr(10) || 'data:' || chr(10) || '  '", f"('password: ' || {_hex(23, 24)})", "''", "keys",
         "KUBERNETES_SECRET_YAML", "kubernetes-secret-yaml"),
)


#: Texts of about 1.5 KB that one task scans.
TEXTS_PER_TASK = 8_000


def spread(rows: DataFrame, texts_per_row: float = 1.0) -> DataFrame:
    """Small rows that grow into texts, dealt over as many tasks as their texts need.

    A table of a few megabytes is read in one task, and the cores that a session knows of when a query is built do not
    grow with the table: the number of tasks follows the counted rows. They are dealt in turn, so no key is hot.
    """
    needed = math.ceil(rows.count() * texts_per_row / TEXTS_PER_TASK)
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, needed))


def customers(spark: SparkSession, sf_dir: str, *columns: str, texts_per_row: float = 1.0) -> DataFrame:
    """Columns of the customers, spread before texts are made of them."""
    return spread(spark.read.parquet(f"{sf_dir}/customer.parquet").select(*columns), texts_per_row)


def service_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(log_id, text)``: one derived log per customer."""
    body = " || chr(10) || ".join(f"({p.before} || {p.value} || {p.after})" for p in LOG)
    # Only the keys are moved; every key grows into a text of about 1.5 KB afterwards.
    keys = customers(spark, sf_dir, "c_custkey").withColumn("k", F.col("c_custkey").cast("string"))
    return keys.select(F.col("c_custkey").alias("log_id"), F.expr(body).alias("text"))


SQL_ENTROPY = (
    "list_sum(list_transform(list_distinct(string_split({v}, '')), lambda c: "
    "-((length({v}) - length(replace({v}, c, ''))) / length({v})) "
    "* log2((length({v}) - length(replace({v}, c, ''))) / length({v}))))"
)


def sql_service_log() -> str:
    """CTEs ``log_text (log_id, text)`` and ``log_findings (... , value)`` for DuckDB."""
    columns = ", ".join(
        f"{p.before} AS b{i}, {p.value} AS v{i}, {p.after} AS a{i}" for i, p in enumerate(LOG)
    )
    text = " || chr(10) || ".join(f"b{i} || v{i} || a{i}" for i in range(len(LOG)))
    rows = []
    for i, p in enumerate(LOG):
        if not p.rule:
            continue
        before = " + ".join([*(f"length(b{j}) + length(v{j}) + length(a{j}) + 1" for j in range(i)), f"length(b{i})"])
        test = "TRUE"
        if p.min_entropy is not None:
            test = f"{SQL_ENTROPY.format(v=f'v{i}')} {'>=' if p.at_least else '>'} {p.min_entropy}"
        rows.append(
            f"SELECT log_id, {before} AS s, {before} + length(v{i}) AS e, '{p.category}' AS category, "
            f"'{p.label}' AS label, '{p.rule}' AS rule, v{i} AS value FROM log_parts WHERE {test}"
        )
    return f"""
      log_keys AS (SELECT c_custkey, CAST(c_custkey AS STRING) AS k FROM customer),
      log_parts AS (SELECT c_custkey AS log_id, {columns} FROM log_keys),
      log_text AS (SELECT log_id, {text} AS text FROM log_parts),
      log_spans AS ({' UNION ALL '.join(rows)}),
      log_findings AS (
        SELECT log_id, s AS start, e AS "end", category, rule, value,
               label || '_' || row_number() OVER (PARTITION BY log_id, label ORDER BY s) AS placeholder
        FROM log_spans)
    """
