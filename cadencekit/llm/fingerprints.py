"""I-Match fingerprints: hashes of the terms of randomised lexicon subsets.

The lexicon holds the terms whose document frequency lies in a band, which is a band of inverse document
frequency.  Each subset keeps every lexicon term with its own rate; a text's fingerprint is, per subset, the hash
of its distinct terms there, if it has any.

Terms of a group of copies that holds more of the table than the band allows are not in the lexicon, nor are those of
very few documents.  So a text with less than half of its distinct terms in lexicon subsets also has hashes of
random subsets of its own terms, and one with less than an eighth has only these.  Two texts are compared by the kinds of
hashes that both have.  Texts without any such subset (empty ones too) are told apart by the hash of all their distinct
terms.  Null texts count as empty.  Rows that repeat a
``doc_id`` follow each other in the order of their texts; null ids come last.  Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadencekit.llm.common import numbered, unit_hash
from cadencekit.session import materialise

#: Rates of the subsets: long and short texts each find some that keep a few of their terms.
RATES = tuple(2.0**-k for k in range(3, 11) for _ in range(6))

#: Subsets of own terms are numbered from here; each seed gives one of every rate from disjoint bits of one hash.
OWN, OWN_SEEDS, OWN_BITS = len(RATES), 6, tuple(range(3, 11))
#: In place of a subset: what is known of a text, and its terms that are in lexicon subsets.
ABOUT, INSIDE = -1, -2
#: Texts of so many distinct terms have no hash of one own term alone: a common word may be all that is shared.
LONG = 16


def distinct_terms(text: Column) -> Column:
    """Different lower-cased runs without white space or ASCII punctuation."""
    return F.array_remove(F.array_distinct(F.split(F.lower(text), r"[\s\p{Punct}]+")), "")


def lexicon(docs: DataFrame, text: str = "text", least_share: float = 5e-4, most_share: float = 0.1,
            rates: tuple[float, ...] = RATES) -> DataFrame:
    """``term`` and ``subsets``, the numbers of the subsets it is in (there may be none), of the terms that between ``least_share`` and
    ``most_share`` of the documents hold.

    There are at most (mean number of distinct terms of a document) / ``least_share`` such terms, whatever
    the number of documents."""
    n = docs.count()
    frequencies = (docs.select(F.explode(distinct_terms(F.coalesce(F.col(text), F.lit("")))).alias("term"))
                   .groupBy("term").agg(F.count(F.lit(1)).alias("df")))
    numbers = F.array_compact(F.array(*(
        F.when(unit_hash(F.col("term"), seed=k) < rate, F.lit(k)) for k, rate in enumerate(rates))))
    return (frequencies.where((F.col("df") >= least_share * n) & (F.col("df") <= max(1.0, most_share * n)))
            .select("term", numbers.alias("subsets")))


def own_hashes(term: Column) -> list[Column]:
    return [F.xxhash64(term, F.lit(seed)) for seed in range(OWN_SEEDS)]


def own_numbers(hashes: list[Column]) -> list[Column]:
    """Numbers of the subsets of a text's own terms that the term with these hashes is in, null for the others."""
    found = []
    for seed, bits in enumerate(hashes):
        at = 0
        for level, width in enumerate(OWN_BITS):
            mask = (1 << width) - 1 << at
            found.append(F.when(bits.bitwiseAND(F.lit(mask)) == 0, F.lit(seed * len(OWN_BITS) + OWN + level)))
            at += width
    return found


def subset_name(number: Column, value: Column) -> Column:
    """``number-hash`` of a subset."""
    return F.concat(F.lpad(number.cast("string"), 2, "0"), F.lit("-"), F.lpad(F.lower(F.hex(value)), 16, "0"))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal hashes among the subsets in which either text has a term, of the kinds that both texts have."""
    def shared(c: Column, other: Column) -> Column:
        kind = lambda x: x < str(OWN)
        return F.transform(F.filter(c, lambda x: F.exists(other, lambda y: kind(x) == kind(y))), lambda x: F.substring_index(x, "-", 1))

    either = F.size(F.array_union(shared(a, b), shared(b, a)))
    return F.when(a == b, 1.0).when(either == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / either)


#: Guests that are broadcast at most: 16 bytes each.
MOST_GUESTS = 1_000_000


def _neighbours(docs: DataFrame, width: int) -> DataFrame:
    """Documents in buckets of ``width`` ids with the first document of the bucket below as a guest, so that each
    document meets the next one in its own bucket.  The lowest bucket's guest is the very first document."""
    bucketed = docs.withColumn("bucket", F.coalesce(
        F.col("doc_id") - F.pmod("doc_id", F.lit(width)), F.lit(-(1 << 62))))
    tops = bucketed.groupBy("bucket").agg(F.max("doc_id").alias("top"))
    placed = materialise(numbered(tops, [F.col("bucket").asc()]))
    n = placed.count()
    most = n <= MOST_GUESTS
    hosts = placed.select(F.col("top").alias("doc_id"), F.pmod(F.col("position") + 1, F.lit(max(1, n))).alias("position"))
    hosts = hosts.join(placed.select("position", F.col("bucket").alias("host")), "position").select("doc_id", "host")
    # One guest a bucket: two numbers for each ``width`` ids.  Few are broadcast, so that texts stay where they are.
    hosts = F.broadcast(hosts) if most else hosts
    guests = (docs.join(hosts, docs["doc_id"].eqNullSafe(hosts["doc_id"]))
              .select(docs["doc_id"], docs["text"], F.col("host").alias("bucket"), F.lit(1).alias("guest")))
    return bucketed.select("doc_id", "text", "bucket", F.lit(0).alias("guest")).unionByName(guests)


def edited(text: Column, following: Column) -> Column:
    """The text with its last half replaced by as much of the start of another."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - half), F.substring(following, F.lit(1), half))


def fingerprints(docs: DataFrame, terms: DataFrame, key: str = "doc_id",
                 text: str = "text", width: int = 128, most_broadcast: int = 2_000_000) -> DataFrame:
    """Fingerprints of every whole text and of its edited form, each with its likeness to the text's.

    The texts are shuffled once, by bucket; what follows works within the buckets.  The lexicon is
    broadcast while it has at most ``most_broadcast`` terms, otherwise joined by a shuffle."""
    # Terms of no subset go after the checkpoint: before it, Spark would test every word of every text.
    terms = materialise(terms).where(F.size("subsets") > 0)
    # Lexicon terms bring all their numbers along.
    terms = terms.select("term", F.array_compact(F.concat("subsets", F.array(F.lit(INSIDE), *own_numbers(own_hashes(F.col("term")))))).alias("numbers"))
    if terms.count() <= most_broadcast:
        terms = F.broadcast(terms)
    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    order = [F.col("guest"), F.col("doc_id").desc_nulls_last(), F.col("text")]
    line = Window.partitionBy("bucket").orderBy(*order)
    seated = _neighbours(chosen, width).select(
        "*", F.row_number().over(line).alias("seat"), F.lead("text").over(line).alias("following"))
    # A repeated first id brings more than one guest; only the first is next to anything.
    seated = seated.withColumn("edited", F.when(F.col("guest") == 0, edited(F.col("text"), F.col("following"))))
    versions = F.array(F.struct(F.lit(0).alias("version"), F.col("text").alias("body")),
                       F.struct(F.lit(1).alias("version"), F.col("edited").alias("body")))
    bodies = seated.select(
        "bucket", "seat", "doc_id", "guest", F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"), F.explode(versions).alias("v")).where("v.body is not null")
    found = bodies.select("*", distinct_terms(F.col("v.body")).alias("terms"))
    about = F.struct("doc_id", "guest", "n_chars", "edited_sha256", F.xxhash64(F.sort_array("terms")).alias("whole"))
    place = ["bucket", "seat", "version", "n_terms"]
    # The first entry is no term: it carries what is known of the text, once, and keeps texts without terms.
    entries = F.concat(F.array(F.struct(F.lit("").alias("term"), about.alias("about"))),
                       F.transform("terms", lambda t: F.struct(t.alias("term"), F.when(t == "", about).alias("about"))))
    rows = found.select("bucket", "seat", "v.version", F.size("terms").alias("n_terms"), F.inline(entries)).join(terms, "term", "left")
    own = [f"own{seed}" for seed in range(OWN_SEEDS)]
    rows = rows.select(*place, "about", F.xxhash64("term").alias("value"), (F.col("term") == "").alias("first"), "numbers",
                       *(F.when(F.col("numbers").isNull(), h).alias(name) for name, h in zip(own, own_hashes(F.col("term")))))
    numbers = (F.when(F.col("first"), F.array(F.lit(ABOUT))).when(F.col("numbers").isNotNull(), F.col("numbers"))
               .otherwise(F.array(*own_numbers([F.col(name) for name in own]))))
    numbered_rows = rows.select(*place, "about", "value", F.explode(numbers).alias("number")).where("number is not null")
    # A row for each subset of a text: buffers of fixed size, which need no sort.
    subsets = (numbered_rows.groupBy(*place, "number", F.when(F.col("number") == ABOUT, F.col("about")).alias("about"))
               .agg(F.bit_xor("value").alias("value"), F.count(F.lit(1)).alias("n"))
               .where(~((F.col("number") >= OWN) & (F.col("n_terms") >= LONG) & (F.col("n") < 2))))
    name, number = subset_name(F.col("number"), F.col("value")), F.col("number")
    grouped = subsets.groupBy(*place).agg(
        F.first("about", ignorenulls=True).alias("about"), F.coalesce(F.max(F.when(number == INSIDE, F.col("n"))), F.lit(0)).alias("inside"),
        F.collect_list(F.when((number >= 0) & (number < OWN), name)).alias("lexical"), F.collect_list(F.when(number >= OWN, name)).alias("own"))
    hashes = F.concat(F.when(8 * F.col("inside") >= F.col("n_terms"), F.sort_array("lexical")).otherwise(F.array().cast("array<string>")),
                      F.when(2 * F.col("inside") < F.col("n_terms"), F.sort_array("own")).otherwise(F.array().cast("array<string>")))
    every = F.array(F.concat(F.lit("all-"), F.lpad(F.lower(F.hex("about.whole")), 16, "0")))
    hashed = (grouped.select("bucket", "seat", "version", "about", hashes.alias("hashes"))
              .withColumn("hashes", F.when(F.size("hashes") == 0, every).otherwise(F.col("hashes"))))
    turn = Window.partitionBy("bucket").orderBy("seat", "version")
    beside = hashed.select("version", "about", "hashes", F.lead("hashes", 1).over(turn).alias("other"),
                           F.lead("hashes", 2).over(turn).alias("following"))
    return (beside.where("version = 0 and about.guest = 0")
            .select("about.doc_id", "about.n_chars", "about.edited_sha256", F.array_join("hashes", ".").alias("fingerprint"),
                    F.array_join("other", ".").alias("edited_fingerprint"),
                    likeness(F.col("hashes"), F.col("other")).alias("near_edited"),
                    likeness(F.col("hashes"), F.col("following")).alias("near_next")))
