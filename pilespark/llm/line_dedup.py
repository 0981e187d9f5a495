"""Near-duplicate lines removed across all documents, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components, partitions, small

#: Characters of a shingle; bands of a signature and minima in a band: at a similarity of 0.8 a pair shares a band with
#: probability 1 - (1 - 0.8 ** 3) ** 8 = 0.997 if minima are independent.
SHINGLE, BANDS, WIDTH = 9, 8, 3
BINS = BANDS * WIDTH
#: Expected shingles of a line among which the minima of its bins are sought: a line of more shingles looks at those whose
#: hash is below a bound. Bins from which an empty one borrows, before it takes the first that is full.
SOUGHT, TRIES = 72, 6
#: Lines of a block, and characters in one of them; buckets with lines unlike their pivot are compared in pairs of blocks.
BLOCK, BLOCK_CHARS = 512, 1 << 20
#: Rows of a few longs that may be broadcast (16 MB); more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Lines that are held against one copy of their pivot, and that hang on one node in the edges.
SHARE = 256
#: 64-bit words of a line's bitmap of shingles; 2,048 bits tell lines of up to some 2,500 characters apart.
WORDS = 32


def let(value: Column, body) -> Column:
    """body(value) with value computed once; a plain reuse would be computed again wherever it stands."""
    return F.element_at(F.transform(F.array(value), body), 1)


def code_points(line: Column) -> Column:
    """Four bytes a character, so that a substring is found without a walk."""
    return F.encode(line, "UTF-32")


def starts(codes: Column) -> Column:
    """Places of the SHINGLE-character substrings; a shorter line has one, itself."""
    return F.sequence(F.lit(0), F.greatest(F.lit(0), (F.length(codes) / 4).cast("int") - SHINGLE))


def shingle(codes: Column, at: Column) -> Column:
    return F.xxhash64(F.substring(codes, at * 4 + 1, F.lit(4 * SHINGLE)))


def shingles(line: Column) -> Column:
    """The distinct hashes of all SHINGLE-character substrings of a line.

    The lambda does no more than hash at places in bytes, and array_distinct stands outside it, so that it is generated code.
    """
    places = lambda b: F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(b) - (4 * SHINGLE - 1)), F.lit(4))
    return F.array_distinct(let(code_points(line), lambda b: F.transform(places(b), lambda i: F.xxhash64(F.substring(b, i, F.lit(4 * SHINGLE))))))


def alike(a: Column, b: Column, threshold: float) -> Column:
    """Whether two arrays of distinct hashes have a Jaccard similarity of at least threshold, in millionths.

    n / (|a| + |b| - n) >= t is n * (1 + t) >= t * (|a| + |b|), which has the intersection once and no rounding.
    """
    t = round(threshold * 1_000_000)
    return F.size(F.array_intersect(a, b)).cast("long") * (1_000_000 + t) >= (F.size(a) + F.size(b)).cast("long") * t


def bitmaps(held: DataFrame) -> DataFrame:
    """(id, width, w0, w1, ...) of held(id, line): the number of its shingles, repeats included, and a bit for each one's hash."""
    codes = held.select("id", code_points(F.col("line")).alias("codes"))
    rows = codes.select("id", F.explode(starts(F.col("codes"))).alias("at"), "codes").select("id", F.pmod(shingle(F.col("codes"), F.col("at")), F.lit(64 * WORDS)).cast("int").alias("bit"))
    rows = rows.select("id", F.shiftright("bit", 6).alias("word"), F.expr("shiftleft(1L, bit % 64)").alias("one"))
    # FILTER, not CASE: a row changes one word of the buffer and writes none of the others
    words = [F.coalesce(F.expr(f"bit_or(one) FILTER (WHERE word = {j})"), F.lit(0)).alias(f"w{j}") for j in range(WORDS)]
    return rows.groupBy("id").agg(F.count(F.lit(1)).alias("width"), *words)


def may_be_alike(a: dict[str, Column], b: dict[str, Column], threshold: float) -> Column:
    """Whether two rows of bitmaps(), by name, leave room for a similarity of threshold; never false for lines that have it.

    Each bit that only one line has stands for a shingle at least that the other lacks, so with d such bits and s shingles
    in both, repeats included, n <= (s - d) / 2 are common and n / (n + d) is the most the similarity can be.
    """
    t = round(threshold * 1_000_000)
    d = F.bit_count(a["w0"].bitwiseXOR(b["w0"]))
    for j in range(1, WORDS):
        d = d + F.bit_count(a[f"w{j}"].bitwiseXOR(b[f"w{j}"]))
    s = a["width"] + b["width"]
    return s * (1_000_000 - t) >= d.cast("long") * (1_000_000 + t)


def blank(line: Column) -> Column:
    """Whether a line has white space only, as \\s has it; this looks no further than its first other character, and not by a pattern."""
    return F.ltrim(line, F.lit(" \t\n\x0b\f\r")) == ""


def occurrences(docs: DataFrame, *columns: str) -> DataFrame:
    """columns, line, h1 and h2 of all lines of docs(text, ...) that are not blank; h1 and h2 name a line."""
    lines = docs.select(*(c for c in columns if c != "at"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line")).where(~blank(F.col("line")))
    return lines.select(*columns, "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"))


def signatures(docs: DataFrame) -> DataFrame:
    """(h1, h2, n, bands) of each distinct line of docs(text): how often it stands, and the bands of its MinHash signature.

    The hashes of all its shingles are dealt to BINS bins, and each bin gives its least. They are rows that one generated
    loop makes, hashes and aggregates, not arrays. An empty bin borrows from others in an order of its own, so that short
    lines agree in a bin with the probability that is their similarity, too.
    """
    n = F.greatest(F.lit(1.0), F.length("codes") / 4 - (SHINGLE - 1))
    bound = (F.lit(-(2.0**63)) + F.lit(2.0**64) * F.least(F.lit(1.0), SOUGHT / n)).cast("long")  # of signed hashes
    # the bound is a line's, computed before its rows are made: beside explode() it would be computed for each of them
    lines = occurrences(docs).select("h1", "h2", code_points(F.col("line")).alias("codes")).select("h1", "h2", "codes", bound.alias("bound"))
    rows = lines.select("h1", "h2", "codes", "bound", F.explode(starts(F.col("codes"))).alias("at"))
    rows = rows.select("h1", "h2", "bound", "at", shingle(F.col("codes"), F.col("at")).alias("h")).where("h <= bound or at = 0")
    # FILTER, not CASE: a row changes one bin of the buffer and writes none of the others
    rows = rows.select("h1", "h2", "at", "h", F.pmod("h", F.lit(BINS)).cast("int").alias("bin"))
    least = [F.expr(f"min(h) FILTER (WHERE bin = {j})").alias(f"m{j}") for j in range(BINS)]
    lines = rows.groupBy("h1", "h2").agg(F.expr("count(1) FILTER (WHERE at = 0)").alias("n"), *least)
    any_ = F.coalesce(*(F.col(f"m{j}") for j in range(BINS))).alias("any")
    lend = lambda j: F.coalesce(F.col(f"m{j}"), *(F.col(f"m{(j + (j % 5 + 1) * (2 * t + 1) + t * t) % BINS}") for t in range(TRIES)), F.col("any"))
    filled = lines.select("h1", "h2", "n", *(f"m{j}" for j in range(BINS)), any_).select("h1", "h2", "n", *(lend(j).alias(f"f{j}") for j in range(BINS)))
    bands = F.array(*(F.xxhash64(F.lit(j), *(F.col(f"f{j + k * BANDS}") for k in range(WIDTH))) for j in range(BANDS)))
    return filled.select("h1", "h2", "n", bands.alias("bands"))


def starred(pairs: DataFrame, held: DataFrame, threshold: float, scratch: Scratch, most: int) -> DataFrame:
    """Edges (a, b) that connect the like ones of pairs(id, pivot), `most` at most, each compared exactly; held(id, line)
    has their lines.

    A pivot's line is copied once for each SHARE lines that are held against it, and each share hangs on its pivot by one
    line, so that neither a task nor a node of the edges has to do with all lines of a pivot.
    """
    pairs = pairs.select("pivot", "id").distinct()
    counted = scratch.keep(pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / SHARE).cast("int").alias("shares")), most)
    lead = counted.join(held.withColumnRenamed("id", "pivot").withColumnRenamed("line", "other"), "pivot")
    lead = scratch.keep(lead.select("pivot", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "other"))
    many = scratch.keep(counted.where("shares > 1"), most)
    dealt = pairs.join(small(many, BROADCAST_ROWS), "pivot", "left").join(held, "id")
    dealt = dealt.select("pivot", F.pmod(F.xxhash64("id"), F.coalesce("shares", F.lit(1))).cast("int").alias("share"), "id", "line")
    # few bytes may be long work: a fixed number of partitions is not coalesced, and a pivot's set is made once a share
    n = partitions(pairs.sparkSession)
    dealt = dealt.repartition(n, "pivot", "share")
    lead = lead.repartition(n, "pivot", "share").select("pivot", "share", shingles(F.col("other")).alias("set"))
    near = scratch.keep(dealt.join(lead, ["pivot", "share"]).where(alike(shingles(F.col("line")), F.col("set"), threshold)).select("id", "pivot", "share"))
    heads = near.groupBy("pivot", "share").agg(F.min("id").alias("head"))
    return near.join(heads, ["pivot", "share"]).select(F.col("id").alias("a"), F.when(F.col("id") == F.col("head"), F.col("pivot")).otherwise(F.col("head")).alias("b"))


def similar_lines(lines: DataFrame, texts, threshold: float, scratch: Scratch) -> DataFrame:
    """Verified edges (a, b) that connect all like lines which share a band, between lines(id, bands).

    texts(ids) gives the lines (id, line) of some ids. All lines that share a band are compared with the least of them,
    the bucket's pivot. Two lines that edges connect already need no comparison. Where a bucket still has lines of
    several components, the least line outside the pivot's component is held against the others, too; and in what is left
    after that all pairs of different components are compared, each in the first band it shares, so no pair that shares
    a band is left out. For this a bucket is dealt out in pairs of blocks of some BLOCK lines, and a task holds two blocks
    however large the bucket; the comparisons grow with the lines outside the pivot's component times the lines of a
    bucket, and most need the lines' bitmaps only.
    """
    spark = lines.sparkSession
    banded = lines.select("id", F.explode("bands").alias("key"))
    n, n_lines = partitions(spark), lines.count()
    # most keys belong to one line
    keys = scratch.keep(banded.groupBy("key").agg(F.min("id").alias("pivot"), F.max("id").alias("last")).where("pivot <> last").select("key", "pivot"), BANDS * n_lines // 2)
    met = scratch.keep(banded.join(small(keys, BROADCAST_ROWS), "key").distinct(), BANDS * n_lines)
    n_met = met.count()
    held = scratch.keep(texts(scratch.keep(met.select("id").distinct(), min(n_lines, n_met))))
    edges = scratch.keep(starred(met.where("id <> pivot"), held, threshold, scratch, n_met), n_met)

    def mixed(met: DataFrame, edges: DataFrame) -> DataFrame:
        """met(key, id, pivot) with root and home (the pivot's root), of the buckets that lie in several components."""
        roots = scratch.keep(components(spark, edges, scratch, 2 * n_met).select(F.col("node").alias("id"), "root"), min(n_lines, n_met))
        rooted = scratch.keep(met.join(small(roots, BROADCAST_ROWS), "id", "left").select("key", "id", "pivot", F.coalesce("root", "id").alias("root")), n_met)
        several = rooted.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("last"), F.min(F.when(F.col("id") == F.col("pivot"), F.col("root"))).alias("home")).where("least <> last").select("key", "home")
        return scratch.keep(rooted.join(small(scratch.keep(several, n_met), BROADCAST_ROWS), "key"), n_met)

    rest = mixed(met, edges)
    if rest.isEmpty():
        return edges
    second = rest.groupBy("key").agg(F.min(F.when(F.col("root") != F.col("home"), F.struct("id", "root"))).alias("x")).select("key", F.col("x.id").alias("second"), F.col("x.root").alias("its"))
    rest = scratch.keep(rest.where("id <> pivot").join(scratch.keep(second, n_met), "key").where("id <> second").select("key", "id", "second", "its", "root"), n_met)
    edges = scratch.keep(edges.union(starred(rest.where("root <> its").select("id", F.col("second").alias("pivot")), held, threshold, scratch, n_met)), 2 * n_met)
    # the lines that neither pivot stands for; the least of them takes the pivot's place
    least = scratch.keep(rest.groupBy("key").agg(F.min("id").alias("pivot")), n_met)
    rest = mixed(rest.select("key", "id").join(least, "key"), edges)
    if rest.isEmpty():
        return edges
    # which band a key is of, and the bands of its lines, to compare a pair in one bucket only
    ids = scratch.keep(rest.select("id").distinct(), n_met)
    bands = lines.join(small(ids, BROADCAST_ROWS), "id", "left_semi")
    facts = scratch.keep(bitmaps(held.join(small(ids, BROADCAST_ROWS), "id", "left_semi")).join(bands, "id").join(held.select("id", F.length("line").alias("chars")), "id"))
    rest = rest.join(facts.select("id", "chars", "bands"), "id").select("key", "id", "root", "chars", (F.col("root") != F.col("home")).alias("open"), F.array_position("bands", F.col("key")).alias("band"))
    sizes = rest.groupBy("key", "band").agg(F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("ids"))
    # of the buckets with the same lines, as several bands give, the one of the first band is enough
    sizes = sizes.groupBy("n", "chars", "ids").agg(F.min(F.struct("band", "key")).alias("x")).select("x.key", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("chars") / BLOCK_CHARS)).cast("int").alias("blocks"))
    rest = scratch.keep(rest.drop("chars").join(scratch.keep(sizes, n_met), "key").withColumn("mine", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int")), n_met)
    # an open line's block meets every block
    group = lambda i, j: F.xxhash64("key", i, j).alias("group")
    blocks = rest.where("open").select("key", F.col("mine").alias("asker")).distinct()
    asked = rest.join(blocks, "key").select(group("asker", "mine"), "id", "root", "open")
    asking = rest.where("open").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(group("mine", "other"), "id", "root", "band")
    told = facts.drop("chars").join(held, "id")
    return edges.union(compared(asking.join(told, "id"), asked.join(told, "id"), threshold, n))


def compared(asking: DataFrame, asked: DataFrame, threshold: float, n: int) -> DataFrame:
    """Edges (a, b) between lines of two roots of asking and asked(group, id, root, line, bands, width, w0, ...) in a group.

    asking also has band, the place in bands of the bucket, and asked has open. The cheap conditions come first: that the
    bucket is the first they share, then their bitmaps. Columns that are known not to be null keep the condition short
    enough for the JVM to compile.
    """
    numbers = ["width", *(f"w{j}" for j in range(WORDS))]

    def side(df: DataFrame) -> DataFrame:
        known = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("id", "root", *numbers)]
        keys = [F.coalesce(F.get("bands", F.lit(i)), F.lit(0).cast("long")).alias(f"k{i}") for i in range(BANDS - 1)]
        more = [F.coalesce(c, d).alias(c) for c, d in (("band", F.lit(0).cast("long")), ("open", F.lit(True))) if c in df.columns]
        return df.repartition(n, "group").select("group", *known, *keys, *more, shingles(F.col("line")).alias("set"))

    left, right = side(asking).alias("l"), side(asked).alias("r")
    l, r = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))  # noqa: E741
    wanted = (l("group") == r("group")) & (l("root") != r("root")) & (~r("open") | (l("id") < r("id")))
    for i in range(BANDS - 1):
        wanted = wanted & ((l("band") <= i + 1) | (l(f"k{i}") != r(f"k{i}")))
    a, b = ({c: x(c) for c in numbers} for x in (l, r))
    pairs = left.join(right, wanted & may_be_alike(a, b, threshold) & alike(l("set"), r("set"), threshold))
    return pairs.select(l("id").alias("a"), r("id").alias("b")).distinct()


def line_dedup(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with text_col holding the lines that stay, and n_lines, n_removed (which replace columns of these names).

    Lines are equal, or alike at a Jaccard similarity of their character shingles (all substrings of SHINGLE
    characters) of at least threshold; of each connected component of lines, over all documents, the one with the least
    (id, hash of the text, line number) stays. Candidates share a band of a MinHash signature and are verified exactly;
    components come from distributed union-find. Lines end at a line feed only; lines of white space only, a carriage
    return included, are no duplicates and stay. A null text stays null, with 0 lines; an empty text has one line, blank.
    Rows with a null id are cleaned like others and come last in the order of ids; rows that repeat an id are told apart
    by their text, and rows that repeat both keep the same lines. All rows and all other columns stay; an empty table
    gives none.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "lines")
    named = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text_col)).alias("salt"), F.col(text_col).alias("text")).where("text is not null")
    lines = scratch.keep(signatures(named))

    def texts(ids: DataFrame) -> DataFrame:
        """(id, line) of the ids."""
        every = occurrences(named).select(F.col("h1").alias("id"), "line")
        return every.join(small(ids, BROADCAST_ROWS), "id", "left_semi").dropDuplicates(["id"])

    # half a name is enough to propose pairs; equal lines are told by both halves
    edges = scratch.keep(similar_lines(lines.select(F.col("h1").alias("id"), "bands"), texts, threshold, scratch))
    scratch.only(lines, edges)
    n_lines = lines.count()
    roots = components(spark, edges, scratch, edges.count()).select(F.col("node").alias("h1"), "root")
    touched = lines.select("h1", "h2", "n").join(roots, "h1", "left").where("root is not null or n > 1")
    touched = scratch.keep(touched.select("h1", "h2", F.coalesce("root", "h1").alias("c1"), F.when(F.col("root").isNull(), F.col("h2")).alias("c2")), n_lines)
    scratch.only(touched)
    places = scratch.keep(occurrences(named, "doc", "salt", "at").drop("line").join(small(touched, BROADCAST_ROWS), ["h1", "h2"]).select("doc", "salt", "at", "c1", "c2"))
    first = places.groupBy("c1", "c2").agg(F.min(F.struct(F.col("doc").isNull().alias("last"), "doc", "salt", "at")).alias("x"))
    stay = scratch.keep(first.select(F.col("x.doc").alias("d"), F.col("x.salt").alias("s"), F.col("x.at").alias("a")), n_lines)
    same = F.col("doc").eqNullSafe(F.col("d")) & (F.col("salt") == F.col("s"))
    gone = places.join(small(stay, BROADCAST_ROWS), same & (F.col("at") == F.col("a")), "left_anti")
    removed = scratch.keep(gone.groupBy(F.col("doc").alias("d"), F.col("salt").alias("s")).agg(F.collect_set("at").alias("gone")))
    scratch.only(removed)
    marked = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text_col)).alias("salt"))
    joined = marked.join(small(removed, 2 * BROADCAST_ROWS, "gone"), same, "left")
    text = F.col("row").getField(text_col)
    whole = F.split(text, "\n", -1)
    left = lambda x: F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("gone")), lambda i: F.get(x, i))
    kept = F.when(F.col("gone").isNull(), text).otherwise(F.array_join(let(whole, left), "\n"))
    out = joined.select("row", kept.alias("kept"), F.when(text.isNull(), 0).otherwise(F.size(whole)).cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"))
    columns = [F.col("kept").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*columns, "n_lines", "n_removed")
