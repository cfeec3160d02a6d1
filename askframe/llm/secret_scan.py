"""Secrets in texts: candidates by their form or by the word that introduces them, false positives removed by a random forest.

The forest is trained (by Spark's own trees, in the JVM) on labelled findings: candidate length, how well its character
transitions fit those of the corpus's words, how much of it the corpus's dictionary covers, whether it is a path, and the
words beside it. Dictionary and transitions are counted over all texts. No table here labels findings, so the labelled set is
generated from a seed: credentials of common forms next to the words that introduce them, and what is mistaken for them
(digests, identifiers, addresses, paths and names made of the corpus's words, numbers) in its usual surroundings. It has a
fixed, documented size. Features, scoring and spans are DataFrame functions.
"""

from __future__ import annotations

import math
import random
import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import kept, most_frequent, tidy
from .spans import find, keyed, listed

# A candidate's form, what introduces one, and what is introduced otherwise.
CANDIDATE = r"(?<![A-Za-z0-9_+/.@-])(?:(?=[A-Za-z_+/.@-]*+[0-9])[A-Za-z0-9_+/.@-]{8,}+|[A-Za-z0-9_+/.@-]{16,}+)={0,2}"
INTRODUCES = "password|passwd|pwd|passphrase|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credential|signing"
DENIES = "commit|sha1?|sha256|md5|checksum|digest|hash|uuid|guid|rev|revision|version|build|id|isbn|card|tel|phone|file|path|url|see|from"
#: What follows an introducing word and = or :, in quotes up to their end, else without closing marks; of 6 characters or more.
ASSIGNED = rf"""(?i)(?:{INTRODUCES})["']?\s*+[:=]\s*+(?!["']?(?:{INTRODUCES})["']?\s*+[:=])(?:"[^"\s]{{6,}}|'[^'\s]{{6,}}|[^\s"']\S{{4,}}[^\s"',;.)\]}}>])"""
VALUE = rf"""(?i)\A(?:{INTRODUCES})["']?\s*+[:=]\s*+["']?(\S+)\z"""
FEATURES = ["length", "digits", "uppers", "symbols", "changes", "transitions", "distinct", "words", "slashes", "dots", "extension", "rooted", "at", "hexadecimal", "prefix", "assigned", "quoted", "closed", "introduced", "denied"]
#: Labelled findings of each kind; the bound of the training set.
LABELLED = 1500
#: Words of the dictionary, the most frequent of the corpus, and letters of the shortest.
DICTIONARY, LEAST_LETTERS = 1 << 16, 4
#: Letters of the transition model: a to z, and one for all other characters.
ALPHABET = 27


def word_counts(rows: DataFrame) -> DataFrame:
    """word, n: runs of the letters a to z, lower-cased, in all texts, as a kept table."""
    words = F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")
    return kept(rows.select(words).where("word != ''").groupBy("word").agg(F.count(F.lit(1)).alias("n")))


def transition_table(counts: DataFrame) -> list[float]:
    """log2 of how likely each of ALPHABET letters follows each, in words and their edges, by add-one counts."""
    edged = F.concat(F.lit("{"), F.col("word"), F.lit("{"))  # { follows z
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word") + 1), lambda k: F.substring(edged, k, F.lit(2)))).alias("pair")
    sums = {r["pair"]: r["n"] for r in counts.select(pair, "n").groupBy("pair").agg(F.sum("n").alias("n")).collect()}  # ALPHABET squared at most
    table = []
    for a in range(ALPHABET):
        row = [sums.get(chr(97 + a) + chr(97 + b), 0) + 1 for b in range(ALPHABET)]
        table += [math.log2(x / sum(row)) for x in row]
    return table


def features(value: Column, before: Column, after: Column, covered: Column, transitions: list[float]) -> dict[str, Column]:
    """Length, character transitions, dictionary coverage, path and neighbouring words of a candidate."""
    n = F.char_length(value)

    def share(pattern: str) -> Column:
        return 1 - F.char_length(F.regexp_replace(value, pattern, "")) / n

    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[a-z]+", "a"), "[A-Z]+", "A"), "[0-9]+", "9"), "[^aA9]+", "-")
    near = F.lower(before)
    letters = F.transform(F.split(F.lower(value), ""), lambda c: F.when(c.between("a", "z"), F.ascii(c) - 97).otherwise(ALPHABET - 1))
    table = F.lit(transitions)
    steps = F.zip_with(F.slice(letters, 1, n - 1), F.slice(letters, 2, n - 1), lambda a, b: F.get(table, a * ALPHABET + b))
    return {
        "length": n.cast("double"),
        "digits": share("[0-9]"),
        "uppers": share("[A-Z]"),
        "symbols": share("[A-Za-z0-9]") * -1 + 1,
        "changes": F.char_length(shape) / n,
        "transitions": F.aggregate(steps, F.lit(0.0), lambda a, x: a + x) / (n - 1),
        "distinct": F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(64)),
        "words": covered / n,
        "slashes": share("/"),
        "dots": share(r"\."),
        "extension": value.rlike(r"\.[A-Za-z]{1,5}\z").cast("double"),
        "rooted": value.rlike(r"\A\.{0,2}/").cast("double"),
        "at": value.contains("@").cast("double"),
        "hexadecimal": value.rlike(r"\A[0-9a-f]+\z").cast("double"),
        "prefix": value.rlike(r"\A(?:AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk_live_|AIza|eyJ|glpat-)").cast("double"),
        "assigned": before.rlike(r"[:=]\s*[\"']?\z").cast("double"),
        "quoted": before.rlike(r"[\"']\z").cast("double"),
        "closed": after.rlike(r"\A[\"'\s]").cast("double"),
        "introduced": near.rlike(rf"(?:{INTRODUCES})[\"']?[\s:=]*[\"']?\z").cast("double"),
        "denied": near.rlike(rf"(?:\A|[^a-z])(?:{DENIES})[\s:=#(]*[\"']?\z").cast("double"),
    }


def described(found: DataFrame, dictionary: DataFrame, transitions: list[float], others: list[str]) -> DataFrame:
    """The columns others and every feature of found (candidate, a number of the row; value, before, after; a kept table).

    A candidate's words are its runs of letters, parted where a lower-case letter meets an upper-case one; the dictionary, of
    at most DICTIONARY rows, is broadcast."""
    parts = F.split(F.lower(F.regexp_replace("value", "(?<=[a-z])(?=[A-Z])", " ")), "[^a-z]+")
    words = found.select("candidate", F.explode(parts).alias("word")).where(F.char_length("word") >= LEAST_LETTERS)
    covered = words.join(F.broadcast(dictionary.select("word")), "word").groupBy("candidate").agg(F.sum(F.char_length("word")).alias("covered"))
    both = found.join(covered, "candidate", "left")
    made = features(F.col("value"), F.col("before"), F.col("after"), F.coalesce("covered", F.lit(0)), transitions)
    return both.select(*others, *(c.alias(k) for k, c in made.items()))


def labelled(spark: SparkSession, vocabulary: list[str], n: int = LABELLED, seed: int = 20) -> DataFrame:
    """candidate, value, before, after, label of n findings that are secrets and n that aren't, and half as many short ones of
    each after an introducing word; the same rows for the same seed and vocabulary, of which names and paths are made."""
    r = random.Random(seed)
    low, digit, hexa = string.ascii_lowercase, string.digits, "0123456789abcdef"
    full, upper = string.ascii_letters + digit, string.ascii_uppercase + digit

    def made(alphabet: str, a: int, b: int) -> str:
        return "".join(r.choice(alphabet) for _ in range(r.randint(a, b)))

    def word() -> str:
        return r.choice(vocabulary) if vocabulary and r.random() < 0.8 else made(low, 3, 9)

    def prose() -> str:
        return " ".join(word() for _ in range(3)) + " "

    names = ["password", "passwd", "secret", "token", "api_key", "API-KEY", "access_key", "auth", "private_key"]
    joins = ["=", ": ", " = ", '="', ' = "', ": '", "='"]
    rows = []
    for _ in range(n):
        kind = r.randrange(6)
        if kind == 0:
            rows.append(("AKIA" + made(upper, 16, 16), prose(), " ", 1.0))
        elif kind == 1:
            rows.append((r.choice(["ghp_", "xoxb-", "sk_live_", "AIza", "glpat-"]) + made(full, 24, 40), r.choice([prose(), prose() + "token="]), " ", 1.0))
        else:
            value = made(r.choice([hexa, full, full + "+/"]), 16, r.choice([18, 24, 40, 64]))
            rows.append((value, prose() + r.choice(names) + r.choice(joins), r.choice([" ", '"', "\n"]), 1.0))
    for _ in range(n):
        kind = r.randrange(9)
        before = prose()
        if kind == 0:
            value, before = made(hexa, 40, 40), before + r.choice(["commit ", "sha1: ", "checksum: ", "digest ", "rev "])
        elif kind == 1:
            value, before = "-".join(made(hexa, k, k) for k in (8, 4, 4, 4, 12)), before + r.choice(["", "id ", "uuid: ", "id="])
        elif kind == 2:
            value = "/".join([r.choice(["usr", "home", "src", "var", "", "."]), word(), word() + made(digit, 1, 2), word() + r.choice([".py", ".html", ".json", ""])])
        elif kind == 3:
            value = r.choice([made(digit, 8, 19), "-".join([made(digit, 4, 4), made(digit, 2, 2), made(digit, 2, 2)]), made(digit, 1, 3) + "." + made(digit, 6, 9)])
        elif kind == 4:
            value = ".".join(word() + made(digit, 0, 2) for _ in range(3)) + made(digit, 0, 3) + r.choice([".com", ".org", ".example.net"])
        elif kind == 5:
            value = word() + "." + made(digit, 1, 3) + "@" + word() + made(digit, 0, 1) + ".example.com"
        elif kind == 6:
            value = r.choice("-_").join([word(), word(), word(), made(digit, 0, 4) or word()])
        elif kind == 7:
            value = ".".join(str(r.randrange(256)) for _ in range(4)) + "." + made(digit, 3, 6)
        else:
            value = r.choice(["".join(word() for _ in range(3)), "".join(word().title() for _ in range(3))]) + made(digit, 0, 2)
            value += made(low, 16, 16)[: max(0, 8 - len(value))]
        rows.append((value, before, r.choice([" ", ".", "\n"]), 0.0))
    words = ["required", "string", "optional", "missing", "invalid", "hidden", "expired", "nothing", "provided", "please", "forgotten", "Optional[str]", "undefined", "getToken()", "read_token()", "request.token", "os.environ", "process.env.TOKEN", "${SECRET}", "<password>", "********", "changeme", "your-password", "example"]
    for _ in range(n // 2):
        own = [word() + made(digit, 1, 4) + r.choice(["", word()]) + made("!#$%&*@", 0, 2), word().title() + made("!#$%&*@", 1, 2) + made(digit, 1, 3), made(low, 3, 8) + made(digit, 1, 4) + made(low, 0, 5) + made("!#$%&*@", 0, 2), made(full + "!#$%&*", 6, 24), made(string.ascii_letters, 8, 24), made(low, 10, 20)]
        rows.append((r.choice(own), prose() + r.choice(names) + r.choice(joins), r.choice([" ", '"', "\n", ","]), 1.0))
        rows.append((r.choice(words), prose() + r.choice([*names, "auth", "token", "password"]) + r.choice(joins), r.choice([" ", '"', "\n", ",", "."]), 0.0))
    return spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "candidate long, value string, before string, after string, label double")


def forest(spark: SparkSession, dictionary: DataFrame, transitions: list[float], trees: int = 20, depth: int = 7):
    """A forest trained on labelled()."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    vocabulary = [r["word"] for r in dictionary.orderBy(F.desc("n"), "word").limit(400).collect()]
    own = described(labelled(spark, vocabulary).coalesce(1), dictionary, transitions, ["candidate", "label"])
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(own.coalesce(1).sortWithinPartitions("candidate"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=9, featureSubsetStrategy="sqrt").fit(vectors)


def as_column(model) -> Column:
    """The forest's probability of a secret as one expression over the feature columns."""

    def walk(node) -> Column:
        if node.numDescendants() == 0:
            stats = node.impurityStats().stats()
            total = sum(stats)
            return F.lit(float(stats[1] / total))
        split = node.split()
        return F.when(F.col(FEATURES[split.featureIndex()]) <= split.threshold(), walk(node.leftChild())).otherwise(walk(node.rightChild()))

    trees = model._call_java("trees")
    parts = [walk(t.rootNode()) for t in trees]
    return sum(parts[1:], parts[0]) / len(parts)


@tidy
def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """doc_id, n_candidates, n_secrets, spans (secret:start:end in code points, joined by commas), top of every row.

    Candidates are runs of the common form (8 characters or more with a digit, or 16 of any kind) and whatever an introducing
    word assigns; a secret within another is part of it.
    top is the highest probability of a candidate, null without any. A null or empty text has no candidate. Rows that
    repeat an id or text get the same result each; a row without an id is searched like any other. Very long texts and runs
    take one pass. An empty table gives no rows; other columns are not read.
    """
    rows = keyed(docs, id_col, text_col)
    counts = word_counts(rows)
    dictionary = kept(most_frequent(counts.where(F.char_length("word").between(LEAST_LETTERS, 64)), "n", F.xxhash64("word"), DICTIONARY))
    transitions = transition_table(counts)
    both = find(rows, {"secret": CANDIDATE, "assigned": ASSIGNED})
    assigned, value = F.col("kind") == "assigned", F.regexp_extract("value", VALUE, 1)
    start, length = F.col("end") - F.char_length(value), F.char_length("value") - F.char_length(value)
    before = F.concat("before", F.substring(F.col("value"), F.lit(1), length))
    parts = F.struct(assigned.alias("a"), F.when(assigned, value).otherwise(F.col("value")).alias("value"), F.when(assigned, before).otherwise(F.col("before")).alias("before"), "after")
    placed = both.select("key", F.lit("secret").alias("kind"), F.when(assigned, start).otherwise(F.col("start")).alias("start"), "end", parts.alias("m"))
    found = placed.groupBy("key", "kind", "start", "end").agg(F.max("m").alias("m")).select("key", "kind", "start", "end", "m.value", "m.before", "m.after")
    found = kept(found.withColumn("candidate", F.monotonically_increasing_id()))
    own = described(found, dictionary, transitions, ["key", "kind", "start", "end"])
    scored = own.select("key", "kind", "start", "end", as_column(forest(docs.sparkSession, dictionary, transitions)).alias("p"))
    wider = Window.partitionBy("key").orderBy("start", F.desc("end")).rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.max(F.when(F.col("p") >= threshold, F.col("end"))).over(wider) >= F.col("end"), F.lit(False))
    scored = scored.withColumn("secret", (F.col("p") >= threshold) & ~inside)
    one = F.struct(F.col("start"), F.lit(1).alias("rank"), F.col("kind"), F.col("end"))
    lists = scored.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("p").alias("top"), F.collect_list(F.when(F.col("secret"), one)).alias("all"))
    out = rows.select("key", "doc_id").join(lists, "key", "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_candidates"), F.coalesce(F.size("all"), F.lit(0)).cast("long").alias("n_secrets"), F.coalesce(listed(F.col("all")), F.lit("")).alias("spans"), "top")
