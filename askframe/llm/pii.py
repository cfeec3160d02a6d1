"""Personal data: patterns for what has a form, and corpus statistics for the words that give it away.

Entities are the values that the patterns find. Over the whole corpus, how much a term tells of an entity is its pointwise
mutual information with it as a share of the entity's own information: log2(p(e|t) / p(e)) / -log2 p(e), where p(e) is the
share of the texts that mention the entity and p(e|t) that of the texts with the term. A term that tells nearly all is
removed, one that tells much is generalised, wherever it stands in a text that mentions the entity. All of it is DataFrame
functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, discard, few, free_name, kept, lookup, numbered, tidy
from .spans import find, keyed, listed

# The kinds in their order and their patterns. The possessive quantifiers and the looks behind give the same
# leftmost matches as the plain patterns, in one pass over long runs.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "phone": "+"}
WORD = r"\p{L}++"
#: Texts without the entity that are added to those with a term.
PRIOR = 2
KINDS = [*PATTERNS, "generalised", "removed"]


def _valid() -> Column:
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
    digits = F.regexp_replace("value", "[^0-9]", "")
    n = F.char_length(digits)
    wide = F.lpad(digits, 19, "0")
    luhn = sum((_digit(wide, p) for p in range(1, 20)), F.lit(0))
    return F.when(F.col("kind") == "ip", F.col("value").rlike(rf"\A{part}(?:\.{part}){{3}}\z")).when(F.col("kind") == "card", n.between(12, 19) & (luhn % 10 == 0)).when(F.col("kind") == "phone", n.between(9, 15)).otherwise(True)


def _digit(text: Column, p: int) -> Column:
    """What the p-th of 19 digits adds to the Luhn sum."""
    d = F.substring(text, p, 1).cast("int")
    return d if p % 2 else d * 2 - F.when(d > 4, 9).otherwise(0)


def base_spans(rows: DataFrame) -> DataFrame:
    """Valid matches of the patterns in keyed() rows; a failing match is dropped and its text not searched again."""
    return find(rows, PATTERNS, NEEDS).where(_valid())


def disclosing_terms(entities: DataFrame, texts: DataFrame, rows: DataFrame, generalise: float) -> DataFrame:
    """key, term, disclosure: terms of a text that tell generalise of the information of an entity in it, or more.

    entities: key and entity, each once; texts: the rows that have one; all three are kept tables. All counts are of rows,
    also of copies. To the rows with a term PRIOR are added that lack the entity, so that a single one proves little in a
    small corpus. As the share is at most n_e / (n_t + PRIOR), a pair beyond that bound can't reach generalise and isn't
    counted; no other pair is left out. Of entities that occur in the same texts, as those that only one text mentions, one
    speaks for all, as they have the same shares.
    """

    def terms(of: DataFrame) -> DataFrame:
        words = F.array_distinct(F.transform(F.filter(F.split("text", r"\P{L}+"), lambda w: w != ""), F.lower))
        return of.select("key", F.explode(words).alias("term"))

    total = rows.count()
    counts = terms(rows).groupBy("term").agg(F.count(F.lit(1)).alias("n_t"))
    where = [F.bit_xor(F.xxhash64("key", F.lit(k))).alias(f"at{k}") for k in (1, 2)]
    n_e = entities.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e"), *where)
    spoken = n_e.groupBy("n_e", "at1", "at2").agg(F.min("entity").alias("entity")).select("entity", "n_e")
    most = F.pow("n_e", F.lit(generalise)) * F.pow(F.lit(float(total)), F.lit(1 - generalise)) * (1 + 1e-9) - PRIOR
    weighed = kept(lookup(entities, cut(spoken), ["entity"]).withColumn("most", most))
    top = weighed.agg(F.max("most")).first()[0]
    rare = counts.where(F.col("n_t") <= F.lit(top))
    mentions = weighed.groupBy("key").agg(F.max("most").alias("most_of_text"))
    near = lookup(kept(terms(texts)), cut(rare), ["term"]).join(mentions, "key").where("n_t <= most_of_text")
    pairs = kept(near.join(weighed, "key").where("n_t <= most").select("key", "entity", "term", "n_t", "n_e"))
    share = F.count(F.lit(1)) / (F.first("n_t") + PRIOR)
    p_e = F.first("n_e") / F.lit(total)
    told = F.when(p_e < 1, F.log2(share / p_e) / -F.log2(p_e)).otherwise(0.0)
    telling = pairs.groupBy("entity", "term").agg(told.alias("disclosure")).where(F.col("disclosure") >= generalise)
    return lookup(pairs, cut(telling), ["entity", "term"]).groupBy("key", "term").agg(F.max("disclosure").alias("disclosure"))


def all_spans(rows: DataFrame, generalise: float = 0.6, remove: float = 0.85) -> DataFrame:
    """key, kind, start, end of the base spans and of the disclosing terms in the same text, in keyed() rows.

    A term that overlaps a base span is part of it and adds nothing.
    """
    base = kept(base_spans(rows))
    entities = kept(base.select("key", F.concat_ws(":", "kind", F.lower("value")).alias("entity")).distinct())
    texts = kept(rows.select("key", "text").join(few(entities.select("key").distinct()), "key", "left_semi"), "zstd")
    terms = kept(disclosing_terms(entities, texts, rows, generalise))
    words = find(texts.join(few(terms.select("key").distinct()), "key", "left_semi"), {"word": WORD})
    label = F.when(F.col("disclosure") >= remove, "removed").otherwise("generalised").alias("kind")
    told = words.withColumn("term", F.lower("value")).join(terms, ["key", "term"]).select("key", "start", "end", label)
    both = base.select("key", "kind", "start", "end").unionByName(told.select("key", "kind", "start", "end"))
    is_base = F.col("kind").isin(list(PATTERNS))
    order = Window.partitionBy("key").orderBy("start")
    before, after = order.rangeBetween(Window.unboundedPreceding, 0), order.rangeBetween(0, Window.unboundedFollowing)
    ends, begins = F.max(F.when(is_base, F.col("end"))).over(before), F.min(F.when(is_base, F.col("start"))).over(after)
    marked = both.withColumns({"ends": ends, "begins": begins})
    out = kept(marked.where(is_base | ((F.coalesce("ends", F.lit(-1)) <= F.col("start")) & (F.coalesce("begins", F.col("end")) >= F.col("end")))).select("key", "kind", "start", "end"))
    discard(base, entities, texts, terms)
    return out


def _rank(kind: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, KINDS)), kind)


def _of(kind: str):
    return lambda s: s["kind"] == kind


@tidy
def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_terms of every row.

    A null or empty text has no spans. Rows are searched one by one, so rows that repeat an id or text have the same spans
    each; a row without an id is searched like any other. Very long texts take one pass a pattern. An empty table gives no rows; other columns are not read.
    """
    rows = keyed(docs, id_col, text_col)
    spans = all_spans(rows, **settings)
    one = F.struct(F.col("start"), _rank(F.col("kind")).alias("rank"), F.col("kind"), F.col("end"))
    lists = spans.groupBy("key").agg(F.collect_list(one).alias("all"))
    base = F.filter("all", lambda s: s["rank"] <= len(PATTERNS))
    out = rows.select("key", "doc_id").join(lists, "key", "left").withColumn("all", F.coalesce("all", F.filter(F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("rank"), F.lit("").alias("kind"), F.lit(0).cast("long").alias("end"))), lambda s: F.lit(False))))
    counts = [F.size(F.filter("all", _of(k))).cast("long").alias(f"n_{k}") for k in PATTERNS]
    return out.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("all")).alias("spans"), F.size(F.filter("all", lambda s: s["rank"] > len(PATTERNS))).cast("long").alias("n_terms"))


@tidy
def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """docs with every span of text_col replaced: a base span by its kind in brackets, a generalised term by [TERM], a
    removed one by nothing. Overlapping spans are replaced together, as the first. Texts without spans stay as they are,
    null included; all columns and rows stay."""
    table, row = numbered(docs)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    spans = all_spans(table.select(F.col(row).alias("key"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text")), **settings)
    found = free_name(table.columns, "_spans")
    order = Window.partitionBy("key").orderBy("start", _rank(F.col("kind")))
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    isles = spans.withColumn("new", F.coalesce(reach <= F.col("start"), F.lit(True)).cast("int")).withColumn("isle", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    label = F.when(F.col("first") == "removed", "").when(F.col("first") == "generalised", "[TERM]").otherwise(F.concat(F.lit("["), F.upper("first"), F.lit("]")))
    merged = isles.groupBy("key", "isle").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("kind", F.struct("start", _rank(F.col("kind")))).alias("first")).select("key", F.struct("start", "end", label.alias("label")).alias("s"))
    lists = merged.groupBy("key").agg(F.array_sort(F.collect_list("s")).alias(found)).withColumnRenamed("key", row)
    lists = kept(lists)
    marked = few(lists.select(row))
    joined = table.join(marked, row, "left_semi").join(lists, row)  # only texts with spans travel
    rest = table.join(marked, row, "left_anti").select(*docs.columns)

    def piece(s: Column, k: Column) -> Column:
        last = F.when(k > 0, F.get(found, k - 1)["end"]).otherwise(0)
        return F.concat(F.substring(text, last + 1, s["start"] - last), s["label"])

    end = F.element_at(found, -1)["end"]
    new = F.concat(F.array_join(F.transform(found, piece), ""), F.substring(text, end + 1, F.char_length(text)))
    return joined.select(*(new.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns)).unionByName(rest.withColumn(text_col, rest[text_col].cast("string")))
