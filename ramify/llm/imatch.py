"""I-Match document fingerprints over randomised lexicon subsets, by DataFrame functions alone.

The lexicon is the terms whose document frequency, over distinct texts, lies in a band of shares of these, that is of inverse
document frequencies. As the frequencies of all terms add up to the distinct terms of all documents, at most (mean distinct terms
of a document) / low terms are in the band, at any size of the corpus.

From the lexicon `subsets` families of subsets are drawn with a seed, each family as a ladder of densities 1/4, 1/16, ..., the
same for all documents. A fingerprint has the hash of a document's sorted distinct lexicon terms, and of those of them that are in
each subset.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import id_in, id_out, partitions, range_of, table

#: Between terms: all but letters and digits.
GAP = r"[^\p{L}\p{N}]+"
SUBSETS, LEVELS, SEED = 16, 5, 42
#: The entry of a subset without a term.
EMPTY = 0
#: Lexicon and copied texts are broadcast below so many rows (8 and 16 bytes each), and joined by a shuffle beyond.
BROADCAST_TERMS = 2_000_000


def terms(text: Column) -> Column:
    """The terms of a text as 63-bit hashes, repeats included."""
    words = F.filter(F.split(F.lower(text), GAP), lambda w: w != "")
    return F.transform(words, lambda w: F.shiftrightunsigned(F.xxhash64(w), 1))


def _few(df: DataFrame) -> DataFrame:
    """df, dealt anew into one partition of 16 for a table of a few bytes a row: its files and what is started to write them
    are then not as many as the partitions that texts or terms need."""
    return df.repartition(max(1, partitions(df.sparkSession) // 16))


def _bounded(df: DataFrame, most: int) -> DataFrame:
    """df, marked for broadcast if it has at most so many rows."""
    return F.broadcast(df) if df.count() <= most else df


def lexicon(texts: DataFrame, low: float, high: float, least: int = 3, broadcast_rows: int = BROADCAST_TERMS) -> DataFrame:
    """(key) of the terms that are in at least low and at most high of all distinct texts, or at most in `least` texts.

    Each of c copies of a text counts 1 / c, so that a text in a third of all rows is one text. Counts by term are summed before
    the shuffle.
    """
    hashed = texts.select(F.xxhash64("text").alias("h"), "text")
    copies = table(_few(hashed.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")), "copies")
    n = texts.count() - (copies.agg(F.sum(F.col("c") - 1)).first()[0] or 0)
    own = hashed.select("h", F.array_distinct(terms(F.col("text"))).alias("keys")).join(_bounded(copies, broadcast_rows), "h", "left")
    df = own.select((1 / F.coalesce("c", F.lit(1))).alias("w"), F.explode("keys").alias("key")).groupBy("key").agg(F.sum("w").alias("df"))
    off = 1e-6  # sums of 1 / c are a little beside whole numbers
    return table(_few(df.where((F.col("df") >= low * n - off) & (F.col("df") <= max(high * n, least) + off)).select("key")), "lexicon")


def by_code(rows: DataFrame) -> DataFrame:
    """about only beside code 0: with each code it would be most of what the grouping by row sorts and spills."""
    return rows.withColumn("about", F.when(F.col("code") == 0, F.col("about")))


def drawn(seed: int, family: Column, level: int, term: Column) -> Column:
    """Whether a term is in the subset of a family at a level: with probability 4**-level, and only if at the level before."""
    return F.xxhash64(term, family.cast("long") + F.lit(seed).cast("long")).bitwiseAND(F.lit(4**level - 1).cast("long")) == 0


def entry(keys: Column) -> Column:
    """The hash of sorted terms as 16 bits; EMPTY for no term."""
    return F.when(F.size(keys) == 0, EMPTY).otherwise(F.pmod(F.xxhash64(keys), F.lit(65535)) + 1).cast("int")


def with_fingerprint(df: DataFrame, keys: str, plain: Column, out: str, subsets: int, levels: int, seed: int) -> DataFrame:
    """Adds struct(whole, parts, plain): the entries of all terms and, by level, of the subsets; and, for texts without a lexicon
    term, the text's own hash.

    Each step is a projection of its own, so that no lambda draws a row's terms again for each entry.
    """

    def thinned(lists: str, level: int) -> Column:
        return F.transform(lists, lambda own, j: F.filter(own, lambda t: drawn(seed, j, level, t)))

    families = F.sequence(F.lit(0), F.lit(subsets - 1))
    df = df.withColumn("__level1", F.transform(families, lambda j: F.filter(F.col(keys), lambda t: drawn(seed, j, 1, t))))
    for level in range(2, levels + 1):
        df = df.withColumn(f"__level{level}", thinned(f"__level{level - 1}", level))
    names = [f"__level{n}" for n in range(1, levels + 1)]
    made = F.struct(entry(F.col(keys)).alias("whole"), F.array(*(F.transform(n, entry) for n in names)).alias("parts"), F.when(F.size(keys) == 0, plain).alias("plain"))
    return df.withColumn(out, made).drop(*names)


def shown(fp: Column) -> Column:
    """As text: four digits for each entry; without a lexicon term, x and the text's hash."""
    hexes = F.transform(F.concat(F.array(fp["whole"]), F.flatten(fp["parts"])), lambda x: F.lpad(F.hex(x), 4, "0"))
    return F.lower(F.when(fp["plain"].isNotNull(), F.concat(F.lit("x"), F.lpad(F.hex(fp["plain"]), 16, "0"))).otherwise(F.array_join(hexes, "")))


def likeness(f: Column, g: Column, subsets: int) -> Column:
    """The share of equal entries among those that either has, at the sparsest level at which either has half of the entries; where
    there is no such level, among all entries of all levels. Texts without lexicon terms are alike if they are equal.

    At a sparse level an entry is one term or two, so the share follows the share of terms in common; a denser one says less
    than that, and a sparser one too little.
    """

    def tally(a: Column, b: Column) -> Column:
        pairs = F.zip_with(a, b, lambda x, y: F.when((x == EMPTY) & (y == EMPTY), 0).when(x == y, 2).otherwise(1))
        return F.struct(F.size(F.filter(pairs, lambda p: p == 2)).alias("same"), F.size(F.filter(pairs, lambda p: p > 0)).alias("either"))

    by_level = F.zip_with(f["parts"], g["parts"], tally)
    every = F.concat(F.array(tally(F.array(f["whole"]), F.array(g["whole"]))), by_level)
    total = F.aggregate(every, F.struct(F.lit(0).alias("same"), F.lit(0).alias("either")), lambda a, t: F.struct((a["same"] + t["same"]).alias("same"), (a["either"] + t["either"]).alias("either")))
    best = F.coalesce(F.try_element_at(F.filter(by_level, lambda t: 2 * t["either"] >= subsets), F.lit(-1)), total)
    none = f["plain"].isNotNull() & g["plain"].isNotNull()
    return F.when(none, (f["plain"] == g["plain"]).cast("double")).otherwise(F.coalesce(F.try_divide(best["same"], best["either"]), F.lit(0.0)))


def fingerprints(
    docs: DataFrame, key: str = "doc_id", text: str = "text", low: float = 1 / 5000, high: float = 1 / 20, least: int = 3, subsets: int = SUBSETS, levels: int = LEVELS, seed: int = SEED, broadcast_rows: int = BROADCAST_TERMS
) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many, or all, of the next row's text,
    in descending order of id and then of the text's hash; after the last row comes the first. Null text: as empty. A null id
    sorts below all others. Repeated rows are rows of their own, so a row's next may be its like. A single row is its own next.
    Very long texts are read whole, as a row. An empty table gives an empty result. Other columns are not read.

    Rows meet their next ones in one exchange, by ranges of ids from quantiles over all ids; what follows stays in these ranges. An
    id with more rows than a range is divided by the text's hash.
    """
    spark = docs.sparkSession
    own = docs.select(id_in(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    known = lexicon(own, low, high, least, broadcast_rows)
    n = partitions(spark)
    quantiles = (own.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100 * n).alias("b")).first().b if n > 1 else None) or []
    hot = {k: c + 1 for k, c in Counter(quantiles).items() if c > 1}
    th = F.shiftrightunsigned(F.xxhash64("text"), 1)
    ranged = own.withColumn("th", th).withColumn("bucket", range_of(F.col("doc_id"), F.shiftright("th", 32), sorted(set(quantiles)), hot))

    # the first rows of ranges, at most some two for each partition: what the last row of the range above has as its next
    tops = ranged.groupBy("bucket").agg(F.max(F.struct("doc_id", "th")).alias("top"))
    down = Window.orderBy(F.desc("bucket"))  # over one row a range
    whole = down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    next_top = tops.select("bucket", F.coalesce(F.lead("top").over(down), F.first("top").over(whole)).alias("top"), F.coalesce(F.lead("bucket").over(down), F.first("bucket").over(whole)).alias("next_bucket"))
    next_top = table(next_top.select("bucket", "next_bucket", F.col("top.doc_id").alias("doc_id"), F.col("top.th").alias("th")), "ranges")
    heads = own.withColumn("th", th).join(F.broadcast(next_top), ["doc_id", "th"]).groupBy("bucket").agg(F.max("text").alias("head"))

    order = Window.partitionBy("bucket").orderBy(F.desc("doc_id"), F.desc("th"), F.desc("text"))
    rows = ranged.select("bucket", "doc_id", "text", F.row_number().over(order).alias("pos"), F.lead("text").over(order).alias("after"))
    rows = rows.join(heads, "bucket", "left").withColumn("after", F.coalesce("after", "head"))
    size = F.char_length("text")
    cut = F.floor(size / 3).cast("int")
    rows = rows.select("bucket", "pos", "doc_id", "text", size.cast("long").alias("n_chars"), F.concat(F.col("text").substr(F.lit(1), size - cut), F.col("after").substr(F.lit(1), cut)).alias("edited"))

    # a term of the text is an even code, one of the edited text an odd code; code 0 is each row's own, and in the lexicon
    codes = F.concat(F.transform(terms(F.col("text")), lambda t: F.shiftleft(t, 1)), F.transform(terms(F.col("edited")), lambda t: F.shiftleft(t, 1).bitwiseOR(F.lit(1).cast("long"))))
    about = F.struct("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.xxhash64("text").alias("plain"), F.xxhash64("edited").alias("edited_plain"))
    # two projections: in one, explode would come first and the hashes of whole texts be made again for each code
    found = rows.select("bucket", "pos", about.alias("about"), F.array_append(F.array_distinct(codes), F.lit(0).cast("long")).alias("codes"))
    found = by_code(found.select("bucket", "pos", "about", F.explode("codes").alias("code")))
    known = known.where("key <> 0").union(spark.range(1).select(F.col("id").alias("key")))
    found = found.join(_bounded(known, broadcast_rows), F.shiftrightunsigned("code", 1) == F.col("key"), "left_semi")
    found = found.groupBy("bucket", "pos").agg(F.first("about", ignorenulls=True).alias("about"), F.collect_list(F.when(F.col("code") != 0, F.col("code"))).alias("codes"))

    def keys(flag: int) -> Column:
        return F.sort_array(F.transform(F.filter("codes", lambda c: c.bitwiseAND(1) == flag), lambda c: F.shiftrightunsigned(c, 1)))

    found = found.select("bucket", "pos", "about", keys(0).alias("k"), keys(1).alias("e"))
    found = with_fingerprint(found, "k", F.col("about.plain"), "fp", subsets, levels, seed)
    found = with_fingerprint(found, "e", F.col("about.edited_plain"), "ep", subsets, levels, seed).drop("k", "e")
    found = table(found.withColumn("after", F.lead("fp").over(Window.partitionBy("bucket").orderBy("pos"))), "fingerprints")
    first = found.where("pos = 1").select(F.col("bucket").alias("next_bucket"), F.col("fp").alias("top"))
    ends = next_top.select("bucket", "next_bucket").join(first, "next_bucket").drop("next_bucket")  # one row a range
    found = found.join(F.broadcast(ends), "bucket", "left").withColumn("after", F.coalesce("after", "top"))
    return found.select(id_out("about.doc_id").alias("doc_id"), "about.n_chars", "about.edited_sha256", shown(F.col("fp")).alias("fingerprint"), shown(F.col("ep")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("ep"), subsets).alias("near_edited"), likeness(F.col("fp"), F.col("after"), subsets).alias("near_next"))
