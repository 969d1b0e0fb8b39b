"""Secret scan with a battery of randomness tests, in column expressions only."""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netquarry.llm.common import stored, whole_text

# The base patterns and the least lengths of their matches.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_VALUE = 6
ACCESS = r"AKIA[A-Z0-9]+"
ACCESS_LENGTH = 20
# A run of 24 or more is the same as a whole run that turns out to be that long.
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "random")

CANDIDATE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
# The alphabets, in the order of their digits' values.
ENCODINGS = {
    "hex": (r"^[0-9a-f]+$", string.digits + "abcdef"),
    "hex_upper": (r"^[0-9A-F]+$", string.digits + "ABCDEF"),
    "base32": (r"^[A-Z2-7]+$", string.ascii_uppercase + "234567"),
    "base62": (r"^[A-Za-z0-9]+$", string.ascii_uppercase + string.ascii_lowercase + string.digits),
    "base64": (r"^[A-Za-z0-9+/]+$", string.ascii_uppercase + string.ascii_lowercase + string.digits + "+/"),
    "base64url": (r"^[A-Za-z0-9_-]+$", string.ascii_uppercase + string.ascii_lowercase + string.digits + "-_"),
}
BINS, LEAST_BIN = 100, 2
BLOCK = 256


def with_running_sums(df: DataFrame, name: str, values: str) -> DataFrame:
    """Add running sums of an array of longs, in blocks, so that appending stays cheap for long arrays."""
    none, zero = F.array().cast("array<long>"), F.lit(0).cast("long")

    def sums(xs: Column, start: Column) -> Column:
        return F.aggregate(
            xs, F.struct(start.alias("s"), none.alias("a")),
            lambda acc, x: F.struct((acc["s"] + x).alias("s"), F.concat(acc["a"], F.array(acc["s"] + x)).alias("a")),
            lambda acc: acc["a"],
        )

    starts = F.filter(F.sequence(F.lit(0), F.size(values), F.lit(BLOCK)), lambda k: k < F.size(values))
    df = df.withColumn("__blocks", F.transform(starts, lambda k: F.slice(values, k + 1, BLOCK)))
    totals = F.transform("__blocks", lambda block: F.aggregate(block, zero, lambda s, x: s + x))
    df = df.withColumn("__before", F.slice(F.concat(F.array(zero), sums(totals, zero)), F.lit(1), F.size("__blocks")))
    return df.withColumn(name, F.flatten(F.zip_with("__blocks", "__before", sums))).drop("__blocks", "__before")


def with_matches(df: DataFrame, name: str, text: str, pattern: str, group: int = 0) -> DataFrame:
    """Add leftmost matches as ``array<struct<start, end, value>>``: code points, end exclusive.

    ``value`` is the group.  What lies between the matches comes from a split at the same pattern, so
    places are running sums of lengths.  Every step is a column of its own: inside an array function
    an expression would be computed anew for each element.
    """
    df = df.withColumn("__found", F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    df = df.withColumn("__gaps", F.slice(F.split(F.col(text), pattern, -1), F.lit(1), F.size("__found")))
    df = df.withColumn("__steps", F.zip_with("__found", "__gaps", lambda m, g: (F.length(m) + F.length(g)).cast("long")))
    df = with_running_sums(df, "__ends", "__steps")
    values = F.col("__found") if group == 0 else F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))
    df = df.withColumn(
        "__places",
        F.zip_with("__found", "__ends", lambda m, end: F.struct((end - F.length(m)).alias("start"), end.alias("end"))),
    )
    whole = F.zip_with(
        "__places", values, lambda p, v: F.struct(p["start"].alias("start"), p["end"].alias("end"), v.alias("value"))
    )
    return df.withColumn(name, whole).drop("__found", "__gaps", "__steps", "__ends", "__places")


def normal_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, by the usual rational formula with five terms."""
    a = F.abs(z)
    t = 1 / (1 + F.lit(0.2316419) * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) * F.lit(0.3989422804014327) * poly
    return F.when(z >= 0, tail).otherwise(1 - tail)


def with_battery(df: DataFrame, column: str) -> DataFrame:
    """Test candidates: ``array<struct<start, end, stratum, p>>``; those that fit no encoding of keys go.

    ``p`` is the combined p-value under the hypothesis that the string is random.  Chi-squared test of
    equal digit counts, runs test of digits in the lower and the upper half, and serial correlation of
    neighbours; the three are combined by the sum of their logarithms, whose tail is closed for six
    degrees of freedom.  Each step adds to the structs, so that nothing is computed twice.
    """

    def step(df: DataFrame, add: Callable[[Column], dict[str, Column]], keep: tuple[str, ...]) -> DataFrame:
        return df.withColumn(
            column,
            F.transform(column, lambda c: F.struct(*[c[k].alias(k) for k in keep], *[v.alias(k) for k, v in add(c).items()])),
        )

    place = ("start", "end")

    def encoding(c: Column) -> dict[str, Column]:
        value, number = c["value"], F.lit(None).cast("int")
        mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
        broad = value.rlike("[a-z]") & value.rlike("[A-Z]")
        for i, (name, (pattern, _)) in reversed(list(enumerate(ENCODINGS.items()))):
            fits = value.rlike(pattern) & (broad if name.startswith("base6") else F.lit(True))
            number = F.when(fits, i).otherwise(number)
        return {"number": F.when(mixed, number)}

    def digits(c: Column) -> dict[str, Column]:
        alphabet = F.element_at(F.array(*[F.lit(d) for _, d in ENCODINGS.values()]), c["number"] + 1)
        symbols = F.filter(F.split(c["value"], ""), lambda x: x != "")
        length_class = F.least(F.floor(F.log2(F.length(c["value"]) / F.lit(20.0)) * 2), F.lit(9)).cast("int")
        return {
            "stratum": c["number"] * 10 + F.greatest(length_class, F.lit(0)),
            "k": F.length(alphabet),
            "v": F.transform(symbols, lambda x: F.call_function("instr", alphabet, x) - 1),
        }

    def sums(c: Column) -> dict[str, Column]:
        v, k = c["v"], c["k"]
        first, second = F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1)
        return {
            "n": F.size(v).cast("double"),
            "squares": F.aggregate(
                F.sequence(F.lit(0), k - 1), F.lit(0.0),
                lambda acc, s: acc + F.pow(F.size(F.filter(v, lambda x: x == s)).cast("double"), F.lit(2.0)),
            ),
            "upper": F.size(F.filter(v, lambda x: x * 2 >= k)).cast("double"),
            "turns": F.aggregate(
                F.zip_with(first, second, lambda a, b: ((a * 2 >= k) != (b * 2 >= k)).cast("double")),
                F.lit(1.0), lambda s, x: s + x,
            ),
            "lag": F.aggregate(
                F.zip_with(first, second, lambda a, b: (a - (k - 1) / 2.0) * (b - (k - 1) / 2.0)),
                F.lit(0.0), lambda s, x: s + x,
            ),
        }

    def scores(c: Column) -> dict[str, Column]:
        n, k, df_ = c["n"], c["k"], (c["k"] - 1).cast("double")
        spread = 2.0 / (9.0 * df_)
        chi = F.greatest(c["squares"] * k / n - n, F.lit(0.0))
        product = 2 * c["upper"] * (n - c["upper"])
        variance = product * (product - n) / (n * n * (n - 1))
        return {
            "z1": (F.pow(chi / df_, F.lit(1 / 3)) - (1 - spread)) / F.sqrt(spread),
            "z2": F.abs(F.when(variance > 0, (c["turns"] - (product / n + 1)) / F.sqrt(variance)).otherwise(F.lit(40.0))),
            "z3": F.abs(c["lag"] / ((k * k - 1) / 12.0) / F.sqrt(n - 1)),
        }

    def tails(c: Column) -> dict[str, Column]:
        return {"p1": normal_tail(c["z1"]), "p2": 2 * normal_tail(c["z2"]), "p3": 2 * normal_tail(c["z3"])}

    def half(c: Column) -> dict[str, Column]:
        logs = [F.log(F.least(F.greatest(c[p], F.lit(1e-300)), F.lit(1.0))) for p in ("p1", "p2", "p3")]
        return {"half": -(logs[0] + logs[1] + logs[2])}

    def combined(c: Column) -> dict[str, Column]:
        return {"p": F.exp(-c["half"]) * (1 + c["half"] + c["half"] * c["half"] / 2)}

    df = step(df, lambda c: {"value": F.rtrim(c["value"], F.lit("="))}, place)
    df = step(df, encoding, (*place, "value"))
    df = df.withColumn(column, F.filter(column, lambda c: c["number"].isNotNull()))
    df = step(df, digits, place)
    df = step(df, sums, (*place, "stratum", "k"))
    df = step(df, scores, (*place, "stratum"))
    df = step(df, tails, (*place, "stratum"))
    df = step(df, half, (*place, "stratum"))
    return step(df, combined, (*place, "stratum"))


def random_limits(tested: DataFrame, rate: float, prior: float) -> DataFrame:
    """``stratum, bin``: strings of a stratum (encoding and class of length) in this bin of p and above pass.

    Random strings have even p-values, words small ones.  The number of random strings follows from the
    upper half of the p-values; the limit is the lowest bin from which on at most ``rate`` of the strings
    are too many for it.  In front of bin ``LEAST_BIN``, where one random string in fifty lies, that is all;
    behind it ``prior`` random strings are taken for granted.  So a lone key is found among words, which
    may cost about ``prior`` false finds in a stratum, whatever its size.  A stratum has at most ``BINS`` bins, which bounds the windows.
    """
    bin_of = F.least(F.floor(F.col("t.p") * BINS), F.lit(BINS - 1)).cast("int")
    bins = (
        tested.select(F.explode("tested").alias("t"))
        .groupBy(F.col("t.stratum").alias("stratum"), bin_of.alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    stratum = Window.partitionBy("stratum")
    upper = F.sum(F.when(F.col("bin") * 2 >= BINS, F.col("n")).otherwise(0)).over(stratum)
    above = F.sum("n").over(stratum.orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0))
    # Between two bins that hold strings any may be the limit, and the lowest expects most.
    after = F.coalesce(F.lag("bin").over(stratum.orderBy("bin")) + 1, F.lit(0))
    low = F.when(F.col("bin") >= LEAST_BIN, F.greatest(after, F.lit(LEAST_BIN))).otherwise(after)
    granted = F.when(F.col("low") >= LEAST_BIN, F.lit(prior)).otherwise(0.0)
    expected = (F.col("random") + granted) * (1 - F.col("low") / F.lit(float(BINS)))
    return (
        bins.withColumns({"above": above, "random": 2 * upper, "low": low})
        .where(F.col("above") - expected <= rate * F.col("above"))
        .groupBy("stratum")
        .agg(F.min("low").alias("bin"))
    )


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rate: float = 0.1, prior: float = 2.0) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` and ``n_random``, a row per document.

    Base spans follow the fixed patterns.  A further span (``random``) is a run of key characters that
    overlaps no base span, fits an encoding of keys and passes the battery at its stratum's limit.  The
    limits, at most ten for each encoding, come from all documents and reach the rows as one map.

    Null text is the empty text; a text without spans has the digest of the empty string and ``''``.
    Ids may be null or repeated, other columns are ignored, an empty table gives no rows.
    """
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), whole_text(text).alias("text"))
    for name, pattern, group in (("assign", ASSIGN, 2), ("access", ACCESS, 0), ("hex", HEX, 0), ("runs", CANDIDATE, 0)):
        rows = with_matches(rows, name, "text", pattern, group)

    def kind(found: Column, number: int) -> Column:
        return F.transform(
            found, lambda m: F.struct(m["start"].alias("start"), F.lit(number).alias("kind"), m["end"].alias("end"))
        )

    base = [
        kind(F.filter("assign", lambda m: F.length(m["value"]) >= ASSIGN_VALUE), 0),
        kind(F.filter("access", lambda m: m["end"] - m["start"] >= ACCESS_LENGTH), 1),
        kind(F.col("hex"), 2),
    ]
    rows = rows.withColumn("base", F.array_sort(F.concat(*base)))
    free = F.filter(
        "runs", lambda c: ~F.exists(F.col("base"), lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    )
    rows = with_battery(rows.withColumn("tested", free), "tested")
    rows = stored(rows.select("doc_id", "base", "tested"), "secrets-tested")
    limits = random_limits(rows, rate, prior)
    limit_map = limits.agg(F.map_from_entries(F.collect_list(F.struct("stratum", "bin"))).alias("limits")).scalar()
    rows = rows.withColumn("limits", limit_map)
    passed = F.filter(
        "tested", lambda t: F.coalesce(t["p"] * BINS >= F.try_element_at("limits", t["stratum"]), F.lit(False))
    )
    rows = rows.select("doc_id", "base", kind(passed, KINDS.index("random")).alias("random"))
    names = F.array(*[F.lit(k) for k in KINDS])

    def joined(found: Column) -> Column:
        parts = F.transform(found, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(parts, ",")

    def count(number: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == number)).cast("long").alias(f"n_{KINDS[number]}")

    return rows.select(
        "doc_id", count(0), count(1), count(2),
        F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "random"))).alias("spans"),
        F.size("random").cast("long").alias("n_random"),
    )
