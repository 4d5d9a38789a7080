"""Secret scanning with a random forest that removes false positives.

Candidates are values assigned to names that speak of secrets, values in known formats, long quoted
strings, private key blocks, passwords in URLs and bare runs of letters and digits. Features of a candidate are its length, characters and transitions between them,
how its letter pairs and words agree with the words of the corpus, path marks, and the words
around it. A random forest, trained from labelled findings, gives the probability.

Only column expressions and the forest of the ML library are used. After training the trees
become one SQL expression, so texts are scored and masked in their rows, without a join or a shuffle.

Labelled findings are texts made in Spark from the given documents: words of a bounded sample of documents
around values whose kind is known, secrets on one side and identifiers, placeholders,
digests, paths and data on the other. Word counts cover all documents.

Defined results: null and empty texts have no candidates; every candidate is scored, accepted ones that
overlap become one finding over all they cover, and a rejected one that overlaps an accepted one or a rejected one
before it has no row; equal rows give equal findings; offsets count code points; an empty table
trains nothing and finds nothing. Other columns stay as they are.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspark.functions.arrays import let
from veilspark.functions.text import entropy, find_all, searchable
from veilspark.llm.shared import store

#: Documents whose words surround the labelled findings, and words of the dictionary.
EXAMPLES = 400
DICTIONARY = 4000
TREES, DEPTH, SEED = 16, 5, 17
MASK = "[SECRET]"

# Words that speak of secrets, of other things that look like them, and of placeholders; known formats.
PASSWORD = r"passw(?:or)?d|passwd|passphrase|pwd"
SPEAKS = rf"token|secret|{PASSWORD}|api[ _.-]?key|access[ _.-]?key|private[ _.-]?key|auth|credential"
OTHERWISE = r"commit|revision|sha-?1|sha-?256|md5|checksum|digest|hash|etag|uuid|guid|integrity|fingerprint|build|version"
PLACEHOLDER = r"example|sample|dummy|changeme|change_me|placeholder|your|xxxx|test|redacted|insert|todo|none|null|undefined|\*\*\*\*|\$\{|\{\{|<"
FORMATS = (
    r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|glpat-[A-Za-z0-9_-]{20}|xox[abprs]-[A-Za-z0-9-]{10,}|[sr]k_live_[0-9A-Za-z]{24,}"
    r"|AIza[0-9A-Za-z_-]{35}|SG\.[A-Za-z0-9_-]{22}\.[A-Za-z0-9_-]{43}|npm_[A-Za-z0-9]{36}|eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]*"
)
_GAP = r"[ \t]*+(?:\r?\n[ \t]*+)?+"
#: A value of four and more characters behind an operator, or behind ``is`` if it has a digit.
ASSIGNED = (
    rf"(?i)(?<![A-Za-z0-9_.-])([A-Za-z0-9_.-]*(?:{SPEAKS})[A-Za-z0-9_.-]*)[\"']?{_GAP}"
    rf"(?:=>|:=|=|:|(?<=\s)is(?=\s+[\"']?[^\s\"'`,;0-9]*+[0-9])){_GAP}(?:bearer\s|basic\s)?[\"']?([^\s\"'`,;]{{4,}})"
)
KNOWN = rf"(?<![A-Za-z0-9_-])()({FORMATS})(?![A-Za-z0-9_-])"
QUOTED = r"[\"']()([A-Za-z0-9+/_=-]{24,})[\"']"
_KEY = r"[ A-Z0-9_-]{0,100}PRIVATE KEY(?: BLOCK)?-----"
#: To the end mark; without one, the lines that can be of a key.
BLOCK = (
    rf"()(-----BEGIN{_KEY}(?:[^-]*+(?:-(?!----)[^-]*+)*+-----END{_KEY}"
    r"|(?:(?:\s|\\[nr])*+[A-Za-z0-9+/=]{20,}+)++(?:(?:\s|\\[nr])*+[A-Za-z0-9+/]++={1,2}+)?+))"
)
IN_URL = r"(?<![A-Za-z0-9+.-])([A-Za-z][A-Za-z0-9+.-]{0,24}+://[^\s:/?#@\"'<>`]*+):([^\s/?#\"'<>`]+)(?=@[^\s/?#@\"'<>`])"
#: Letters and digits, of which there is one of each at least.
BARE = r"(?<![A-Za-z0-9_+/-])()((?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{20,}+)(?![+/])"
FEATURES = (
    "length", "entropy", "digits", "upper", "lower", "symbols", "changes", "longest_run", "hex_only", "pairs", "dictionary",
    "slashes", "dots", "in_path", "speaks", "of_password", "otherwise", "placeholder", "known", "assigned", "pieces", "free",
)


_STEMS = ("token", "secret", "passw", "passphrase", "pwd", "key", "auth", "credential")
_MARKS = ("AKIA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "xox", "k_live_", "AIza", "SG.", "npm_", "eyJ")
_SCORED = "array<struct<start:int,end:int,kind:string,name:string,score:double,is_secret:boolean>>"
_CANDIDATE = "array<struct<start:int,last:int,end:int,kind:string,name:string,value:string,before:string,after:string>>"


def _any(text: Column, words: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def candidates(text: Column) -> Column:
    """``array<struct<start, last, end, kind, name, value, before, after>>`` of a text, in order; they may overlap.

    Cheap tests for words go first, so a pattern only runs over texts that may match.
    """
    given = F.coalesce(text, F.lit(""))

    def search(whole: Column) -> Column:
        def found(pattern: str, kind: str, gate: Column) -> Column:
            behind = 1 if kind == "quoted" else 0
            hits = F.when(gate, find_all(whole, pattern, {"name": 1, "value": 2}))

            def one(m: Column) -> Column:
                end = m["end"] - behind
                return F.struct(
                    (end - F.length(m["value"])).cast("int").alias("start"),
                    (-end).cast("int").alias("last"),
                    end.cast("int").alias("end"),
                    F.lit(kind).alias("kind"),
                    m["name"].alias("name"),
                    m["value"].alias("value"),
                    m["before"].alias("before"),
                    m["after"].alias("after"),
                )

            return F.coalesce(F.transform(hits, one).cast(_CANDIDATE), F.array().cast(_CANDIDATE))

        low = F.lower(whole)
        assigned = _any(low, _STEMS) & _any(whole, ("=", ":", "is"))
        quoted = F.contains(whole, F.lit('"')) | F.contains(whole, F.lit("'"))
        return F.array_sort(
            F.concat(
                found(KNOWN, "known", _any(whole, _MARKS)),
                found(ASSIGNED, "assigned", assigned),
                found(QUOTED, "quoted", quoted & whole.rlike(r"[\"'][A-Za-z0-9+/_=-]{24}")),
                found(BLOCK, "block", F.contains(whole, F.lit("PRIVATE KEY"))),
                found(IN_URL, "url", F.contains(whole, F.lit("://")) & F.contains(whole, F.lit("@"))),
                found(BARE, "bare", whole.rlike("[A-Za-z0-9_-]{20}")),
            )
        )

    possible = _any(F.lower(given), _STEMS) | _any(given, (*_MARKS, '"', "'", "PRIVATE KEY", "://")) | given.rlike("[A-Za-z0-9_-]{20}")
    return F.coalesce(F.when(possible, let(searchable(given), search)), F.array().cast(_CANDIDATE))


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``(word, n)`` over all documents: words of letters in lower case."""
    words = docs.select(F.explode(F.split(F.lower(F.col(text)), r"[^\p{L}]+")).alias("word"))
    return words.where("word <> ''").groupBy("word").agg(F.count("*").alias("n"))


class Vocabulary:
    """The frequent words of the corpus and how its letters follow each other; both of bounded size."""

    def __init__(self, docs: DataFrame, text: str = "text", size: int = DICTIONARY) -> None:
        counts = store(word_counts(docs, text), "word-counts").frame
        words = counts.where(F.length("word") >= 3).orderBy(F.col("n").desc(), "word").limit(size)
        self.words = [r.word for r in words.collect()]
        plain = counts.where(F.col("word").rlike("^[a-z]{2,32}$"))
        pairs = plain.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", i, F.lit(2)))).alias("pair"))
        rows = pairs.groupBy("pair").agg(F.sum("n").alias("n")).withColumn(
            "share", F.log2((F.col("n") + 1.0) / (F.sum("n").over(Window.partitionBy(F.substring("pair", 1, 1))) + 26.0))
        )  # at most 26 rows in each of 26 groups
        self.pairs = {r.pair: r.share for r in rows.collect()}

    def dictionary(self) -> Column:
        return F.split(F.lit(" ".join(self.words)), " ")

    def pair_shares(self) -> Column:
        written = ",".join(f"{p}:{s:.4f}" for p, s in sorted(self.pairs.items())) or "aa:0"
        return F.str_to_map(F.lit(written), F.lit(","), F.lit(":")).cast("map<string,double>")


def features(c: Column, vocabulary: Vocabulary) -> Column:
    """The features of a candidate as ``struct<...>`` of doubles."""
    v, n = c["value"], F.length(c["value"]).cast("double")
    low = F.lower(v)
    near = F.lower(F.concat(F.right(c["before"], F.lit(40)), F.lit(" "), c["name"]))
    count = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    flag = lambda test: F.when(test, 1.0).otherwise(0.0)
    pairs = F.transform(
        F.sequence(F.lit(1), F.length(v) - 1), lambda i: F.coalesce(F.try_element_at(vocabulary.pair_shares(), F.substr(low, i, F.lit(2))), F.lit(-9.0))
    )
    pieces = F.regexp_extract_all(v, F.lit(r"\p{Lu}?\p{Ll}+|\p{Lu}+"), F.lit(0))
    covered = F.aggregate(
        F.filter(pieces, lambda p: (F.length(p) >= 3) & F.array_contains(vocabulary.dictionary(), F.lower(p))),
        F.lit(0), lambda s, p: s + F.length(p),
    )
    written = ~low.rlike(PLACEHOLDER)
    known = v.rlike(f"^(?:{FORMATS})$") | ((c["kind"] == "url") & written) | ((c["kind"] == "block") & v.rlike("[A-Za-z0-9+/=]{20}"))
    values = (
        n, entropy(v), count("[0-9]"), count("[A-Z]"), count("[a-z]"), count("[^0-9A-Za-z]"),
        count("(?<=[a-z])[^a-z]|(?<=[A-Z])[^A-Z]|(?<=[0-9])[^0-9]"), count(r"(.)\1\1"), flag(v.rlike("^[0-9a-fA-F-]+$")),
        F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / n, covered / n,
        count("/"), count("[.]"), flag(c["before"].rlike("[/.]$") | (c["after"] == "/") | v.rlike("^[./~]|://")),
        flag(near.rlike(SPEAKS)), flag(F.lower(c["name"]).rlike(rf"(?:{PASSWORD})$") & v.rlike("[0-9!@#%^&*?$]") & written), flag(near.rlike(OTHERWISE)), flag(~written), flag(known),
        flag(c["kind"] == "assigned"), F.size(pieces) / n, flag((c["kind"] == "bare") & ~near.rlike(OTHERWISE) & ~v.rlike("^[0-9a-fA-F-]+$")),
    )
    return F.struct(*[x.cast("double").alias(name) for name, x in zip(FEATURES, values)])


def labelled_findings(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", examples: int = EXAMPLES) -> DataFrame:
    """``(label, text)``: values of known kind between words of a bounded sample of documents."""
    ids = docs.where(F.col(doc_id).isNotNull()).select(doc_id).distinct().orderBy(F.xxhash64(doc_id), doc_id).limit(examples)
    sample = docs.select(doc_id, text).join(F.broadcast(ids), doc_id).where(F.length(text) > 0)
    base = sample.select(
        F.slice(F.regexp_extract_all(F.col(text), F.lit(r"\p{L}{2,24}"), F.lit(0)), F.lit(1), F.lit(12)).alias("w"),
        F.sha2(F.concat(F.lit("finding"), F.col(doc_id).cast("string")), 256).alias("hex"),
        F.sha2(F.concat(F.lit("other"), F.col(doc_id).cast("string")), 256).alias("hex2"),
    ).where(F.size("w") >= 8).repartition(16, "hex")  # few rows, but their findings are many
    b64 = F.base64(F.unhex("hex"))
    base = base.withColumn("b64", b64).withColumn("mixed", F.translate(F.concat(b64, F.base64(F.unhex("hex2"))), "+/=", "kQ7"))
    w = [F.get("w", F.lit(i)) for i in range(8)]
    hex_, mixed = F.col("hex"), F.col("mixed")
    part = lambda x, n, at=1: F.substring(x, at, n)
    lit, low = F.lit, F.lower
    uuid = F.concat_ws("-", part(hex_, 8), part(hex_, 4, 9), part(hex_, 4, 13), part(hex_, 4, 17), part(hex_, 12, 21))
    digits = F.translate(F.col("hex2"), "abcdef", "314159")
    digit = F.substring(digits, 7, 1)
    lower_prefix = F.substring(low(w[3]), 1, 4)
    lines = F.concat_ws("\n", mixed, F.reverse(mixed), F.col("b64"))
    true = [
        (' token = "', part(hex_, 40), '" '), (" secret_key: ", part(mixed, 32), " "), (" API_KEY=", part(mixed, 24), "\n"),
        (' password = "', F.concat(part(mixed, 11), lit("!9")), '" '), (" auth_token=", part(hex_, 32), " "), (" ", F.concat(lit("AKIA"), F.upper(part(mixed, 16))), " "),
        (" ", F.concat(lit("ghp_"), part(mixed, 36)), " "), (' client_secret: "', F.col("b64"), '" '), (' the secret is "', part(mixed, 40), '" '),
        (" Authorization: Bearer ", part(mixed, 48), " "), (' "access_key": "', part(mixed, 30, 5), '", '), (" db_password=", part(mixed, 14, 9), " "),
        (" ", F.concat(lit("-----BEGIN RSA PRIVATE KEY-----\n"), lines, lit("\n-----END RSA PRIVATE KEY-----")), "\n"),
        (" DATABASE_URL=postgres://app:", part(mixed, 12, 3), "@db.internal:5432/main "), (" see https://user:", low(w[3]), "@host.example.org/ "),
        (" redis://:", F.concat(low(w[4]), part(hex_, 3)), "@cache:6379 "), (" amqp://mq:", part(mixed, 4), "@mq.internal "),
        (" ", F.concat(lit("github_pat_"), part(mixed, 22), lit("_"), part(mixed, 50, 20)), " "), (" ", F.concat(lower_prefix, lit("_"), part(mixed, 32, 7)), "\n"),
        (" ", part(mixed, 40, 11), " "), (" ", F.concat(lower_prefix, lit("-"), part(mixed, 28, 3)), " "),
        (" password: ", F.concat(low(w[3]), digit), " "), (" pwd=", part(mixed, 7, 2), "\n"), (" DB_PASSWORD=", part(mixed, 9, 12), " "),
        (' password = "', F.concat(low(w[4]), digit, lit("!")), '" '), (" passwd: ", F.concat(F.initcap(w[3]), part(digits, 4)), " "),
        (' secret    =     "', part(mixed, 16, 30), '" '), (" api key is ", part(hex_, 32, 9), " "), (" the password is ", F.concat(part(mixed, 6, 40), digit), " "),
        (" PASSWORD=", F.concat(part(mixed, 3, 50), lit("@"), digit, part(mixed, 3, 60)), " "), (" passphrase: ", part(mixed, 5, 22), " "),
    ]
    false = [
        (' token = "', F.concat_ws("_", low(w[3]), low(w[4]), low(w[5])), '" '), (" secret = ", F.concat(lit("your_"), low(w[3]), lit("_here")), " "),
        (" password: ", lit("xxxxxxxxxxxx"), " "), (" password: ", F.concat(lit("${"), F.upper(w[4]), lit("_VAULT}")), " "), (' commit "', part(hex_, 40), '" '),
        (' sha256 "', hex_, '" '), (' etag "', part(hex_, 32), '" '), (" token_file = /etc/", F.concat_ws("/", low(w[3]), low(w[4]), low(w[5])), ".conf "),
        (" auth = ", F.concat(F.initcap(w[3]), lit("Factory.get"), F.initcap(w[4]), lit("Instance")), " "), (' checksum "', F.col("b64"), '" '),
        (' "', F.concat_ws("-", *[low(x) for x in w[2:7]]), '" '), (' auth_uuid = "', uuid, '" '), (" secret_name: ", F.concat(low(w[3]), low(w[4]), low(w[5])), " "),
        (" author: ", F.concat_ws(".", w[3], w[4], w[5]), " "), (" key_authority=https://", F.concat(low(w[3]), lit(".example.org/"), low(w[4])), " "),
        (" ", lit("-----BEGIN PRIVATE KEY-----\nYOUR KEY HERE\n-----END PRIVATE KEY-----"), "\n"), (" ", lit("-----BEGIN RSA PRIVATE KEY-----\n...\n-----END RSA PRIVATE KEY-----"), "\n"),
        (" DATABASE_URL=postgres://app:", F.concat(lit("${"), F.upper(w[4]), lit("}")), "@db.internal:5432/main "), (" https://user:", lit("xxxxxxxx"), "@host.example.org/ "),
        (" mysql://root:", F.concat(lit("your_"), low(w[3])), "@db/ "), (" ftp://me:", lit("****"), "@files/ "),
        (" password: ", low(w[3]), " "), (" token: ", low(w[4]), " "), (" auth = ", low(w[5]), " "), (' password: "', F.initcap(w[4]), '" '),
        (" token_count = ", part(digits, 5), " "), (" auth_version: v2.", part(digits, 4), " "), (" author: ", F.concat(F.initcap(w[3]), lit("2024")), " "),
        (" secret: ", lit("true"), " "), (" password: ", lit("null"), " "), (" password_hash = ", F.concat(lit("get_"), low(w[3]), lit("()")), " "),
        (" password = ", F.concat(lit("user."), low(w[3])), " "), (" token is ", F.concat(lit("v1_"), low(w[3])), " "),
        (" commit ", part(hex_, 40), " "), (" sha256 ", hex_, " "), (" ", part(hex_, 40), " "), (" ", part(F.col("hex2"), 32), "\n"), (" ", uuid, " "), (" etag ", part(mixed, 24), " "),
        (" ", F.concat(F.concat_ws("-", *[low(x) for x in w[2:6]]), lit("-2024")), " "), (" ", F.concat(F.concat_ws("_", *[low(x) for x in w[2:6]]), lit("_1")), " "),
        (" ", F.concat(lit("20240131-"), F.concat_ws("-", low(w[3]), low(w[4]), low(w[5]))), " "), (" ", F.concat(*[F.initcap(x) for x in w[2:6]], lit("2")), " "),
    ]
    rows = [F.struct(F.lit(label).alias("label"), F.concat(w[0], lit(" "), w[1], lit(a), v, lit(z), w[2]).alias("text")) for label, kinds in ((1.0, true), (0.0, false)) for a, v, z in kinds]
    return base.select(F.explode(F.array(*rows)).alias("r")).select("r.label", "r.text")


class Forest:
    """The trees of a trained forest as one column expression; ``trees`` are nested ``(feature, limit, low, high)`` or classes."""

    def __init__(self, findings: DataFrame, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        rows = store(
            findings.select("label", F.explode(candidates(F.col("text"))).alias("c")).select("label", features(F.col("c"), vocabulary).alias("f")).select("label", "f.*"),
            "findings",
        ).frame
        self.trees: list = [0.0]
        if rows.select("label").distinct().count() == 2:
            forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=TREES, maxDepth=DEPTH, seed=SEED)
            model = forest.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(rows))
            self.trees = _trees(model.toDebugString)

    def probability(self, f: Column) -> Column:
        """The share of trees that vote for a secret."""

        def grown(tree) -> Column:
            if isinstance(tree, float):
                return F.lit(tree)
            at, limit, low, high = tree
            return F.when(f[FEATURES[at]] <= limit, grown(low)).otherwise(grown(high))

        total = F.lit(0.0)
        for tree in self.trees:
            total = total + grown(tree)
        return total / len(self.trees)

    def findings(self, text: Column, limit: float = 0.5) -> Column:
        """``array<struct<start, end, kind, name, value, score, is_secret>>`` of a text."""

        def one(c: Column) -> Column:
            return let(
                let(features(c, self.vocabulary), self.probability),
                lambda p: F.struct(
                    c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), c["name"].alias("name"),
                    p.alias("score"), (p >= limit).alias("is_secret"),
                ),
            )

        def valued(x: Column) -> Column:
            value = F.substr(text, x["start"] + 1, x["end"] - x["start"])
            return F.struct(x["start"], x["end"], x["kind"], x["name"], value.alias("value"), x["score"], x["is_secret"])

        return F.transform(resolved(F.transform(candidates(text), one).cast(_SCORED)), valued)


def resolved(scored: Column) -> Column:
    """Disjoint findings of scored candidates in order: no accepted one is lost or cut, whatever overlaps it."""

    def add(kept: Column, x: Column) -> Column:
        last, before = F.element_at(kept, -1), F.slice(kept, F.lit(1), F.size(kept) - 1)
        joined = F.struct(
            last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), last["kind"].alias("kind"), last["name"].alias("name"),
            F.greatest(last["score"], x["score"]).alias("score"), F.lit(True).alias("is_secret"),
        )
        return (
            F.when((F.size(kept) == 0) | (x["start"] >= F.element_at(kept, -1)["end"]), F.concat(kept, F.array(x)))
            .when(~x["is_secret"], kept)
            .when(last["is_secret"], F.concat(before, F.array(joined)))
            .otherwise(F.concat(before, F.array(x)))
        )

    return F.aggregate(scored, F.array().cast(_SCORED), lambda kept, x: add(kept, x).cast(_SCORED))


def _trees(written: str) -> list:
    """The trees of a forest from its description."""
    trees = []
    for block in re.split(r"Tree \d+ \(weight [^)]*\):\n", written)[1:]:
        lines = iter([line.strip() for line in block.splitlines() if line.strip()])

        def grow() -> object:
            line = next(lines)
            if line.startswith("Predict:"):
                return float(line.split(":")[1])
            at, limit = re.match(r"If \(feature (\d+) <= ([-0-9.eE]+)\)", line).groups()
            low = grow()
            next(lines)  # the line of the other branch
            return int(at), float(limit), low, grow()

        trees.append(grow())
    return trees


def train(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> Forest:
    return Forest(labelled_findings(docs, text, doc_id), Vocabulary(docs, text))


def scan_secrets(docs: DataFrame, forest: Forest, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row for each candidate: ``(doc_id, start, end, kind, name, value_sha256, score, is_secret)``; values stay out."""
    found = docs.select(doc_id, F.explode(forest.findings(F.col(text))).alias("f"))
    return found.select(doc_id, "f.start", "f.end", "f.kind", "f.name", F.sha2("f.value", 256).alias("value_sha256"), "f.score", "f.is_secret")


def masked(text: Column, forest: Forest) -> Column:
    """The text with every accepted finding replaced by ``MASK``; null stays null."""

    def build(f: Column) -> Column:
        parts = F.transform(
            f,
            lambda x, i: F.concat(
                let(F.when(i == 0, 0).otherwise(F.get(f, i - 1)["end"]), lambda a: F.substr(text, a + 1, x["start"] - a)), F.lit(MASK)
            ),
        )
        tail = F.element_at(f, -1)["end"]
        return F.concat(F.array_join(parts, ""), F.substr(text, tail + 1, F.length(text)))

    secret = F.filter(forest.findings(text), lambda x: x["is_secret"])
    return let(secret, lambda f: F.when(F.size(f) > 0, build(f)).otherwise(text))
