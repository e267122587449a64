"""Secret scanning: candidate strings judged by a random forest. [native]

Candidates are whole private keys (from their first to their last line), runs of 16 or more characters of secrets (letters, digits and "_+/=.-"), and values of
8 or more characters that are assigned to a name of a secret. What is assigned counts without its name; a candidate other than a key block has a digit or is of mixed case,
so passwords of plain lower-case words are not found. Each gets features of its length, of its character transitions (between lower-case and
upper-case letters, digits and marks), of the share of its letters that words of a dictionary and common letter pairs cover, of its likeness to a path, and of the
neighbouring words before and after it. A random forest (Spark's own, in the JVM) trained from labelled findings tells secrets from identifiers, addresses, paths, numbers and long words.

The dictionary is made of the most frequent words of all texts that are scanned (WORDS of them, besides a few common ones), or given. The labelled findings come from
`labelled_findings`, a bounded set (FINDINGS rows) made by SQL expressions from row numbers after the published formats of tokens and keys; other labelled findings with the same columns can be given.

Everything is DataFrame operations. The trained trees and the dictionary become constants of the plan, bounded by TREES, DEPTH and WORDS, so that scanning and redacting
are one projection of each text: no shuffle of texts, no join, and every row is judged and redacted by itself, whatever its id. Only the count of words is exchanged.

Nulls and texts without candidates give no findings and stay as they are. Empty tables give none. Repeated rows give their findings each. Null ids are allowed.
Very long texts are scanned whole. Offsets are code points from 0. `scan` drops input columns beyond id and text, `redacted` keeps all.
"""

from __future__ import annotations

import json

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laurel.llm import shared

#: Names of secrets with what assigns to them.
NAMED = r"(?i:passw(?:or)?d|passphrase|pwd|secret|token|api[_-]?key)[\"']? {0,3}[=:] {0,3}[\"']?"
CANDIDATE = rf"-----BEGIN [A-Z ]{{0,20}}PRIVATE KEY-----[A-Za-z0-9+/=\s:,\-]{{1,9000}}?-----END [A-Z ]{{0,20}}PRIVATE KEY-----|{NAMED}[^\s\"']{{8,400}}|(?=[A-Za-z0-9_+/=.\-]{{16}})(?:[A-Za-z0-9_.\-]{{0,30}}?{NAMED}[^\s\"']{{8,400}}|[A-Za-z0-9_+/=.\-]{{16,}})"
#: What stands before the secret in a candidate: a name and a sign of assignment.
HEAD = rf"^(?:{NAMED}|[A-Za-z_.\-]{{1,20}}[=:]+)(?=.)"
#: Labelled findings that are made for training, trees, depth and seed of the forest, and the score from which a finding is kept.
FINDINGS, TREES, DEPTH, SEED, CUT = 6000, 24, 8, 11, 0.5
#: Words of the dictionary, and their lengths.
WORDS, SHORTEST, LONGEST = 800, 4, 12
#: Words that the dictionary always has.
COMMON = "about access account address admin application article button class client company config connection content country data database date default description device document download email error event example file folder form function group header home image index info input item language library license link list login message method model module name network number option order page parameter path person phone picture place post price print private product profile project public question report request response result search section server service session shop site source start state status store string style system table test text time title type update upload user value version video view website window world year".split()
#: Letter pairs that are common in words of European languages (fixed values).
PAIRS = "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur qu ei ie un sc ue os el la do ad ci ja ga sh wh ly"
NEAR = r"(?i)(token|secret|passw(or)?d|passphrase|pwd|api.?key|access.?key|credential|auth|bearer|private.?key|account.?key)\W*$"
DIGEST = r"(?i)(commit|sha-?\d*|md5|checksum|digest|etag|hash|revision|integrity|fingerprint|uuid|guid|build|blob)\W*$"
PREFIX = r"^(-----BEGIN|AKIA|ASIA|gh[pousr]_|github_pat_|glpat-|xox[abeprs]-|[spr]k_(live|test)_|eyJ|AIza|ya29\.|npm_|pypi-|dop_v1_|SG\.|hf_|key-|AC[0-9a-f]{32})"
FEATURES = ("size", "lower", "upper", "digits", "marks", "changes", "hex", "words", "pairs", "slashes", "dots", "assigned", "named", "digest", "quoted", "address", "prefix", "distinct", "dated", "uuid", "file", "block", "userinfo")


def dictionary(docs: DataFrame, text: str = "text", words: int = WORDS) -> list[str]:
    """COMMON and the `words` most frequent words of SHORTEST to LONGEST ASCII letters in all texts; ties go to the smaller word. As many rows reach the driver."""
    found = docs.select(F.explode(F.split(F.lower(F.col(text)), "[^a-z]+")).alias("w")).where(F.length("w").between(SHORTEST, LONGEST))
    rows = found.groupBy("w").count().orderBy(F.desc("count"), "w").limit(words).collect()
    return sorted({*COMMON, *(r.w for r in rows)})


# Candidates.


def candidates(text: Column) -> Column:
    """Structs of n (of the candidate in its text), start, secret, before (up to 40 characters and the candidate's head) and after (up to 12); empty without any."""
    all_, pieces = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), F.split(text, CANDIDATE, -1)
    parts = F.arrays_zip(all_.alias("c"), pieces.alias("p"), F.slice(pieces, 2, F.size(pieces)).alias("q"))
    # Where each candidate starts follows from the lengths of all that stands before it.
    placed = F.aggregate(
        F.slice(parts, 1, F.size(all_)),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<n:int,start:int,c:string,p:string,q:string>>").alias("all")),
        lambda s, x: F.struct(
            (s["at"] + F.length(x["p"]) + F.length(x["c"])).alias("at"),
            F.concat(s["all"], F.array(F.struct(F.size(s["all"]).alias("n"), (s["at"] + F.length(x["p"])).alias("start"), x["c"].alias("c"), x["p"].alias("p"), x["q"].alias("q")))).alias("all"),
        ),
        lambda s: s["all"],
    )
    with_head = F.transform(placed, lambda x: F.struct(x["n"].alias("n"), x["start"].alias("start"), x["c"].alias("c"), F.regexp_extract(x["c"], HEAD, 0).alias("h"), x["p"].alias("p"), x["q"].alias("q")))
    cut = F.transform(
        with_head,
        lambda x: F.struct(
            x["n"].alias("n"),
            (x["start"] + F.length(x["h"])).alias("start"),
            F.substr(x["c"], F.length(x["h"]) + 1).alias("secret"),
            F.concat(F.right(x["p"], F.lit(40)), x["h"]).alias("before"),
            F.left(x["q"], F.lit(12)).alias("after"),
        ),
    )
    return F.filter(cut, lambda x: x["secret"].rlike("[0-9]") | x["secret"].rlike("(?s)[a-z].*[A-Z].*[A-Z]|[A-Z].*[A-Z].*[a-z]|[A-Z].*[a-z].*[A-Z]"))


# Features.


def share(text: Column, pattern: str) -> Column:
    """Share of the characters that match a class."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern, ""))) / F.greatest(F.length(text), F.lit(1))


def features(secret: Column, before: Column, after: Column, words: list[str]) -> Column:
    """The FEATURES of a candidate as an array."""
    low = F.lower(secret)
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(secret, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "9"), "[^aA9]+", "-")
    letters = F.regexp_replace(low, "[^a-z]", "")
    longest_first = "|".join(sorted((w for w in words if w.isascii() and w.isalpha()), key=lambda w: (-len(w), w)))

    def covered(pattern: str) -> Column:
        return F.when(F.length(letters) > 0, 1 - F.length(F.regexp_replace(letters, f"({pattern})", "")) / F.length(letters)).otherwise(F.lit(0.0))

    def flag(condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False)).cast("double")

    found = {
        "size": F.least(F.length(secret), F.lit(200)),
        "lower": share(secret, "[a-z]"),
        "upper": share(secret, "[A-Z]"),
        "digits": share(secret, "[0-9]"),
        "marks": share(secret, "[^A-Za-z0-9]"),
        "changes": (F.length(shape) - 1) / F.greatest(F.length(secret) - 1, F.lit(1)),
        "hex": flag(secret.rlike("^([0-9a-f]+|[0-9A-F]+)$")),
        "words": covered(longest_first or "(?!)"),
        "pairs": covered("|".join(PAIRS.split())),
        "slashes": F.length(F.regexp_replace(secret, "[^/]", "")),
        "dots": F.length(F.regexp_replace(secret, "[^.]", "")),
        "assigned": flag(before.rlike(r"[=:]\s*[\"']?$")),
        "named": flag(before.rlike(NEAR)),
        "digest": flag(before.rlike(DIGEST)),
        "quoted": flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")),
        "address": flag(before.rlike(r"(@|www\.)$") | (after.rlike("^@") & ~before.rlike(r"://[^\s/@]{1,40}:$"))),
        "prefix": flag(secret.rlike(PREFIX)),
        "distinct": F.size(F.array_distinct(F.split(low, ""))) / F.greatest(F.length(secret), F.lit(1)),
        "dated": flag(secret.rlike(r"(^|[^0-9])(19|20)\d\d[-./_]?[01]\d[-./_]?[0-3]\d")),
        "uuid": flag(low.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")),
        "file": flag(low.rlike(r"\.(html?|php|jpe?g|png|gif|svg|css|js|py|java|json|xml|pdf|txt|csv|zip|gz|com|org|net|de|fr|es)([/.]|$)")),
        "block": flag(secret.contains("PRIVATE KEY-----")),
        "userinfo": flag(before.rlike(r"://[^\s/@]{1,40}:$") & after.rlike("^@")),
    }
    return F.array(*[found[k].cast("double") for k in FEATURES])


# Labelled findings.


def labelled_findings(spark: SparkSession, n: int = FINDINGS, words: list[str] | None = None) -> DataFrame:
    """secret, before, after, label (1: a secret) and kind of `n` made findings, from row numbers and words alone."""
    words = words or COMMON
    base = spark.range(n).selectExpr(
        "id",
        "sha2(concat('a', id), 512) AS h",
        "concat(base64(unhex(sha2(concat('b', id), 512))), base64(unhex(sha2(concat('c', id), 512)))) AS b",
        "CAST(pmod(xxhash64(id), 100000) AS INT) AS r",
    )
    base = base.selectExpr("*", "regexp_replace(b, '[+/=]', '') AS a", "translate(b, '+/=', '-_') AS u")
    listed = F.array(*[F.lit(w) for w in words])
    for k in (1, 2, 3):
        base = base.withColumn(f"w{k}", F.element_at(listed, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(words))) + 1).cast("int")))
    name = "element_at(array('token', 'secret', 'password', 'api_key', 'access_key', 'auth_token', 'client_secret', 'pwd', 'SECRET_KEY', 'passphrase'), 1 + r % 10)"
    sign = "element_at(array(' = \"', '=', ': ', ' = ', '\": \"', ':\"', '=\\''), 1 + CAST(r / 10 AS INT) % 7)"
    assigned = f"concat(w1, ' ', {name}, {sign})"
    prose, plain = "concat(w1, ' ', w2, ' ')", "concat(' ', w3)"
    close = f"CASE WHEN {sign} LIKE '%\"' THEN '\"' WHEN {sign} LIKE '%\\'' THEN '\\'' ELSE ' ' END"
    kinds = {
        "hex assigned": (1, "substr(h, 1, 20 + r % 45)", assigned, close),
        "base64 assigned": (1, "substr(b, 1, 20 + r % 60)", assigned, close),
        "letters and digits assigned": (1, "substr(a, 1, 10 + r % 40)", assigned, close),
        "password assigned": (1, "concat(initcap(w1), element_at(array('!', '#', '_', '@', '', '-'), 1 + r % 6), substr(a, 1, 3 + r % 6), r % 1000)", assigned, close),
        "access key": (1, "concat(element_at(array('AKIA', 'ASIA'), 1 + r % 2), substr(translate(upper(h), '0189', 'QZXW'), 3, 16))", prose, plain),
        "personal token": (1, "concat(element_at(array('ghp_', 'gho_', 'ghs_', 'glpat-', 'npm_', 'hf_', 'dop_v1_'), 1 + r % 7), substr(a, 1, 20 + r % 20))", prose, plain),
        "chat token": (1, "concat('xoxb-', substr(translate(h, 'abcdef', '123456'), 1, 12), '-', substr(a, 1, 24))", prose, plain),
        "payment key": (1, "concat(element_at(array('sk_live_', 'rk_live_', 'sk_test_'), 1 + r % 3), substr(a, 1, 24 + r % 20))", prose, plain),
        "cloud key": (1, "concat('AIza', substr(u, 1, 35))", prose, plain),
        "signed token": (1, "concat('eyJhbGciOiJIUzI1NiJ9.', substr(a, 1, 30 + r % 60), '.', substr(u, 9, 43))", "concat(w1, element_at(array(' Bearer ', ' ', ': '), 1 + r % 3))", "' '"),
        "mail key": (1, "concat('SG.', substr(u, 1, 22), '.', substr(u, 30, 43))", prose, plain),
        "bearer": (1, "substr(u, 1, 24 + r % 50)", "concat('Authorization: Bearer ')", "'\"'"),
        "user in an address": (1, "concat(substr(a, 1, 12 + r % 10), r % 100)", "concat('postgres://', w1, ':')", "concat('@', w2, '.')"),
        "private key": (1, "concat('-----BEGIN RSA PRIVATE KEY-----\\n', b, '\\n', b, '\\n-----END RSA PRIVATE KEY-----')", "concat(w1, '\\n')", "'\\n'"),
        "random bare": (1, "substr(b, 1, 40)", "concat(w1, ' credential ')", "' '"),
        "long word": (0, "concat(w1, w2, w3, r % 10)", prose, plain),
        "camel case": (0, "concat(w1, initcap(w2), initcap(w3), 'Id', CASE WHEN r % 2 = 0 THEN '2' ELSE '' END)", prose, "'('"),
        "snake case": (0, "concat(w1, '_', w2, '_', w3, '_', r % 100)", prose, "' ='"),
        "number": (0, "concat(cast(10000000 + r AS STRING), cast(10000000 + pmod(xxhash64(id, 9), 89999999) AS STRING))", prose, plain),
        "uuid": (0, "concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21, 12))", "concat(w1, element_at(array(' ', ' id=', ' uuid '), 1 + r % 3))", plain),
        "file path": (0, "concat('/', w1, '/', w2, r % 50, '/', w3, '.html')", prose, plain),
        "address path": (0, "concat('www.', w1, w2, '.org/', w3, '/', r)", "'https://'", plain),
        "mail address": (0, "concat(w1, r % 90, '.', w2, '.example.org')", "concat(w3, ' ', w2, '@')", plain),
        "mail name": (0, "concat(w1, '.', w2, w3, r % 1000)", prose, "concat('@', w1)"),
        "date and time": (0, "concat(2000 + r % 25, '-', lpad(1 + r % 12, 2, '0'), '-', lpad(1 + r % 28, 2, '0'), 'T', lpad(r % 24, 2, '0'), '-', lpad(r % 60, 2, '0'), '-00')", prose, plain),
        "version": (0, "concat(w1, '-', r % 9, '.', r % 20, '.', r % 7, '-beta.', r % 100)", prose, plain),
        "checksum": (0, "substr(h, 1, element_at(array(32, 40, 64, 96), 1 + r % 4))", "concat(w1, element_at(array(' commit ', ' sha256:', ' md5: ', ' checksum=', ' etag \"', ' revision '), 1 + r % 6))", plain),
        "integrity": (0, "concat('sha384-', substr(b, 1, 64))", "'integrity=\"'", "'\"'"),
        "image data": (0, "concat('iVBORw0KGgo', substr(b, 1, 80))", "'data:image/png;base64,'", "'\"'"),
        "placeholder": (0, "element_at(array('your_api_key_here_1', 'xxxxxxxxxxxxxxxx1', 'CHANGE_ME_PLEASE_1', 'example_token_0000', '0000000000000000', '1234567890123456', 'abcdefghijklmnop1'), 1 + r % 7)", assigned, close),
        "setting": (0, "concat(w1, '_', w2, r % 10)", "concat(element_at(array('mode', 'name', 'type', 'class', 'lang'), 1 + r % 5), '=\"')", "'\"'"),
        "named setting": (0, "concat(w1, '.', w2, '_', w3, r % 10)", assigned, close),
        "dashes": (0, "concat('----------------', r % 10)", prose, plain),
        "file name": (0, "concat(initcap(w1), '_', initcap(w2), '_', 2000 + r % 25, lpad(1 + r % 12, 2, '0'), lpad(1 + r % 28, 2, '0'), '.pdf')", prose, plain),
        "constant": (0, "concat(upper(w1), '_', upper(w2), '_', lower(w3), r % 10)", prose, plain),
    }
    place = f"pmod(id, {len(kinds)})"

    def pick(k: int) -> str:
        return "CASE " + " ".join(f"WHEN {place} = {i} THEN {x[k]}" for i, x in enumerate(kinds.values())) + " END"

    names = "element_at(array(" + ", ".join(f"'{k}'" for k in kinds) + f"), CAST({place} + 1 AS INT))"
    return base.selectExpr(f"{pick(1)} AS secret", f"{pick(2)} AS before", f"{pick(3)} AS after", f"CAST({pick(0)} AS DOUBLE) AS label", f"{names} AS kind")


# The forest.


def trained(findings: DataFrame, words: list[str]) -> list[list[dict]]:
    """The trees of a forest trained on labelled findings (secret, before, after, label): nodes of f (feature, -1 in a leaf), t (threshold), l and r (children) and p (share of secrets)."""
    rows = findings.select(array_to_vector(features(F.col("secret"), F.col("before"), F.col("after"), words)).alias("features"), "label")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt", maxBins=32, minInstancesPerNode=2)
    spark = findings.sparkSession
    path = shared.new_path(spark, "forest")
    forest.fit(rows.coalesce(1)).write().save(path)
    nodes: dict[int, dict[int, dict]] = {}
    for row in spark.read.parquet(f"{path}/data").collect():  # at most TREES times 2 to the DEPTH + 1
        of = row.nodeData
        total = sum(of.impurityStats)
        leaf = of.leftChild < 0
        share = of.impurityStats[1] / total if total and len(of.impurityStats) > 1 else 0.0
        nodes.setdefault(row.treeID, {})[of.id] = {"f": -1 if leaf else of.split.featureIndex, "t": 0.0 if leaf else of.split.leftCategoriesOrThreshold[0], "l": of.leftChild, "r": of.rightChild, "p": share}
    return [[tree[k] for k in sorted(tree)] for _, tree in sorted(nodes.items())]


def voted(trees: list[list[dict]], x: Column) -> Column:
    """The mean share of secrets in the leaves that the features `x` reach: the forest's probability."""
    table = F.from_json(F.lit(json.dumps(trees)), "array<array<struct<f: int, t: double, l: int, r: int, p: double>>>")

    def leaf(tree: Column) -> Column:
        def turn(k: Column, _: Column) -> Column:
            node = F.get(tree, k)
            return F.when(node["f"] < 0, k).when(F.get(x, node["f"]) <= node["t"], node["l"]).otherwise(node["r"])

        return F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), F.lit(0), turn)

    return F.aggregate(table, F.lit(0.0), lambda s, tree: s + F.get(tree, leaf(tree))["p"]) / len(trees)


def judged(text: Column, trees: list[list[dict]], words: list[str], cut: float) -> Column:
    """Structs of n, start, secret, score and is_secret of a text's candidates."""
    with_features = F.transform(candidates(text), lambda c: F.struct(c["n"].alias("n"), c["start"].alias("start"), c["secret"].alias("secret"), features(c["secret"], c["before"], c["after"], words).alias("x")))
    scored = F.transform(with_features, lambda c: F.struct(c["n"].alias("n"), c["start"].alias("start"), c["secret"].alias("secret"), voted(trees, c["x"]).alias("score")))
    return F.transform(scored, lambda c: F.struct(c["n"].alias("n"), c["start"].alias("start"), c["secret"].alias("secret"), c["score"].alias("score"), (c["score"] >= cut).alias("is_secret")))


def model(docs: DataFrame, text: str = "text", findings: DataFrame | None = None, words: list[str] | None = None) -> tuple[list[list[dict]], list[str]]:
    """The trees and the dictionary for `docs`."""
    words = dictionary(docs, text) if words is None else words
    return trained(findings if findings is not None else labelled_findings(docs.sparkSession, words=words), words), words


def scan(docs: DataFrame, id: str = "doc_id", text: str = "text", findings: DataFrame | None = None, cut: float = CUT, words: list[str] | None = None) -> DataFrame:
    """Every candidate: id, n, start, length, secret, score (0 to 1) and is_secret (the score is at least `cut`)."""
    trees, words = model(docs, text, findings, words)
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text")).where(F.col("text").rlike(CANDIDATE))
    found = rows.select("id", F.explode(judged(F.col("text"), trees, words, cut)).alias("f"))
    return found.select(F.col("id").alias(id), "f.n", "f.start", F.length("f.secret").alias("length"), "f.secret", "f.score", "f.is_secret")


def redacted(docs: DataFrame, id: str = "doc_id", text: str = "text", mark: str = "[secret]", cut: float = CUT, findings: DataFrame | None = None, words: list[str] | None = None) -> DataFrame:
    """The rows of `docs` with every secret replaced by `mark`, each in its own place."""
    trees, words = model(docs, text, findings, words)
    own = F.col(text)
    secrets = F.filter(judged(own, trees, words, cut), lambda f: f["is_secret"])
    # From secret to secret: what stands before it, then the mark; the rest at the end.
    joined = F.aggregate(
        secrets,
        F.struct(F.lit(1).alias("at"), F.lit("").alias("done")),
        lambda s, f: F.struct((f["start"] + F.length(f["secret"]) + 1).alias("at"), F.concat(s["done"], F.substr(own, s["at"], f["start"] + 1 - s["at"]), F.lit(mark)).alias("done")),
        lambda s: F.concat(s["done"], F.substr(own, s["at"])),
    )
    return docs.withColumn(text, F.when(own.rlike(CANDIDATE), joined).otherwise(own))
