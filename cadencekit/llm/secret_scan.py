"""Secret scans: known forms, and runs that look random to character Markov models.

Null texts count as empty: no spans.  Repeated rows are scanned each.  Places count code points, ends are exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadencekit.llm.common import neutral, unit_hash

# The known forms.
ASSIGN = (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST = 6
#: Symbols of the models, and the runs of them that are judged.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
RUN = r"[A-Za-z0-9+/_=-]{%d,}"
KINDS = ("assign", "access", "hex", "random")


def spans_of(text: Column, pattern: str, kind: int, group: int = 0) -> Column:
    """Matches of a pattern in order as structs (start, kind, end, size of the group).

    ``split`` gives what lies between the matches, so the lengths add up to the places."""
    between, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    steps = F.filter(F.arrays_zip(between.alias("gap"), found.alias("hit"), inner.alias("part")), lambda s: s["hit"].isNotNull())
    kinds = "array<struct<start:int,kind:int,end:int,size:int>>"
    start = F.struct(F.lit(0).alias("at"), F.array().cast(kinds).alias("out"))

    def step(state: Column, s: Column) -> Column:
        begin = state["at"] + F.char_length(s["gap"])
        end = begin + F.char_length(s["hit"])
        span = F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"), F.char_length(s["part"]).alias("size"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(span)).alias("out"))

    return F.when(text.rlike(pattern), F.aggregate(steps, start, step)["out"]).otherwise(F.array().cast(kinds))


def base_spans(text: Column) -> Column:
    """Spans of the known forms by start, then kind.  An assignment needs a value of six or more characters."""
    assign = F.filter(spans_of(text, ASSIGN, 0, 2), lambda s: s["size"] >= ASSIGN_LEAST)
    return F.array_sort(F.concat(assign, spans_of(text, ACCESS, 1), spans_of(text, HEX, 2)))


def _pairs(run: Column) -> Column:
    """Numbers of the neighbouring symbols of a run: first * size of the alphabet + second."""
    places = F.sequence(F.lit(1), F.char_length(run) - 1)
    number = lambda at: F.instr(F.lit(ALPHABET), F.substring(run, at, F.lit(1))) - 1
    return F.transform(places, lambda at: number(at) * len(ALPHABET) + number(at + 1))


def train(docs: DataFrame, most_docs: int = 2000, n_random: int = 2000, smooth: float = 0.5, key: str = "doc_id",
          text: str = "text") -> DataFrame:
    """One row with ``ratios``: for each pair of symbols the log of its chance among random strings over its
    chance among ordinary identifiers.

    The labelled samples come from about ``most_docs`` documents picked by a hash of their key: values of known forms
    are random, all other runs of three or more symbols ordinary.  So that every alphabet is met, ``n_random``
    random strings in hexadecimal of both cases and in Base64 are added."""
    total = docs.count()
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    picked = docs.where(F.col(key).isNotNull() & (unit_hash(F.col(key)) * max(1, total) < most_docs)).select(body.alias("body"))
    values = F.concat(F.regexp_extract_all("body", F.lit(ASSIGN), F.lit(2)), F.regexp_extract_all("body", F.lit(ACCESS), F.lit(0)),
                      F.regexp_extract_all("body", F.lit(HEX), F.lit(0)))
    symbols = F.transform(values, lambda v: F.regexp_replace(v, r"\.", ""))
    known = picked.select(F.explode(symbols).alias("run")).where(F.char_length("run") >= 16)
    rest = F.regexp_replace(F.regexp_replace(F.regexp_replace("body", ASSIGN, " "), ACCESS, " "), HEX, " ")
    ordinary = picked.select(F.explode(F.regexp_extract_all(rest, F.lit(RUN % 3), F.lit(0))).alias("run"))
    seed = F.sha2(F.col("id").cast("string").cast("binary"), 256)
    made = docs.sparkSession.range(n_random).select(F.explode(F.array(
        seed, F.upper(seed), F.base64(F.unhex(seed)), F.translate(F.base64(F.unhex(seed)), "+/=", "-_"))).alias("run"))
    runs = (ordinary.select("run", F.lit(0).alias("random")).unionByName(known.select("run", F.lit(1).alias("random")))
            .unionByName(made.select("run", F.lit(1).alias("random"))).where(F.char_length("run") > 1))
    counts = runs.select("random", F.explode(_pairs(F.col("run"))).alias("pair")).groupBy("pair").agg(
        F.count(F.when(F.col("random") == 1, 1)).alias("r"), F.count(F.when(F.col("random") == 0, 1)).alias("o"))
    size = len(ALPHABET)
    every = docs.sparkSession.range(size * size).select(F.col("id").cast("int").alias("pair"))
    filled = every.join(counts, "pair", "left").select("pair", F.coalesce("r", F.lit(0)).alias("r"), F.coalesce("o", F.lit(0)).alias("o"))
    firsts = filled.groupBy(F.floor(F.col("pair") / size).alias("first")).agg(F.sum("r").alias("rs"), F.sum("o").alias("os"))
    ratio = (F.log((F.col("r") + smooth) / (F.col("rs") + smooth * size)) - F.log((F.col("o") + smooth) / (F.col("os") + smooth * size)))
    ratios = filled.join(firsts, F.floor(F.col("pair") / size) == F.col("first")).select("pair", ratio.alias("ratio"))
    # One number for each pair of symbols: a table of fixed size.
    return ratios.agg(F.transform(F.array_sort(F.collect_list(F.struct("pair", "ratio"))), lambda x: x["ratio"]).alias("ratios"))


def scan(docs: DataFrame, model: DataFrame, least_run: int = 16, least_ratio: float = 12.0, text: str = "text",
         name: str = "_spans") -> DataFrame:
    """All columns of ``docs`` and the array of spans (start, kind, end): the known forms, and of the runs of symbols,
    cut at these, the parts of at least ``least_run`` symbols whose log-likelihood ratio is at least ``least_ratio``."""
    ratios = F.lit([float(x) for x in model.first()["ratios"]])
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    runs = RUN % least_run
    found = neutral(docs, text).withColumn("_base", base_spans(body)).withColumn("_runs", spans_of(body, runs, 3))

    def random(s: Column) -> Column:
        run = F.substring(body, s["start"] + 1, s["end"] - s["start"])
        score = F.aggregate(_pairs(run), F.lit(0.0), lambda total, pair: total + F.element_at(ratios, pair + 1))
        return score >= least_ratio

    def parts(run: Column) -> Column:
        """What lies between the base spans, which come by start but may overlap."""
        part = lambda start, end: F.struct(start.alias("start"), run["kind"].alias("kind"), end.alias("end"), (end - start).alias("size"))
        over = F.filter("_base", lambda b: (b["start"] < run["end"]) & (run["start"] < b["end"]))
        state = F.struct(run["start"].alias("at"), F.slice("_runs", 1, 0).alias("out"))
        cut = F.aggregate(over, state, lambda done, b: F.struct(
            F.greatest(done["at"], b["end"]).alias("at"), F.concat(done["out"], F.array(part(done["at"], b["start"]))).alias("out")))
        whole = F.concat(cut["out"], F.array(part(cut["at"], run["end"])))
        return F.when(F.size(over) == 0, F.array(run)).otherwise(F.filter(whole, lambda x: x["size"] >= least_run))

    cut = F.flatten(F.transform("_runs", parts))
    found = found.withColumn("_runs", F.when(F.size("_runs") > 0, cut).otherwise(F.col("_runs")))
    found = found.withColumn("_more", F.when(F.size("_runs") > 0, F.filter("_runs", random)).otherwise(F.col("_runs")))
    return found.withColumn("_found", F.array_sort(F.concat("_base", "_more"))).drop("_base", "_runs", "_more").toDF(*docs.columns, name)


def digest(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(kinds, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """The text with the union of the spans replaced; spans that overlap share one mark."""
    state = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(done: Column, s: Column) -> Column:
        gap = F.substring(text, done["at"] + 1, s["start"] - done["at"])
        fresh = s["start"] >= done["at"]
        return F.struct(F.greatest(done["at"], s["end"]).alias("at"),
                        F.when(fresh, F.concat(done["out"], gap, F.lit(mark))).otherwise(done["out"]).alias("out"))

    end = F.aggregate(spans, state, step)
    return F.when(F.size(spans) > 0, F.concat(end["out"], F.substring(text, end["at"] + 1, F.char_length(text)))).otherwise(text)
