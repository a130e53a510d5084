"""Secret scans with DataFrame functions alone: patterns and a randomness test battery.

Patterns find assignments, access keys and long hexadecimal strings. The battery looks at
every other run of at least LEAST characters that keys are written in, or where a run has no
encoding at its parts between '=' and, of parts without one, between '/' and then '+'. It infers the encoding
and tests it three ways: chi-squared uniformity over the encoding's alphabet, the number of
runs of letter case and digits, and the serial correlation of neighbouring characters. Each
statistic gives the probability of so random a look in prose: text whose letters repeat as
often as COLLISION says, that changes between cases and digits CHANGES times a character,
and whose neighbours are correlated by CORRELATION. Fisher's method combines the three.

False discoveries are controlled over the whole corpus by the Benjamini-Hochberg procedure
within each class of lengths, so that many short candidates don't hide the long ones nor
borrow from them. The procedure needs only counts of a fixed grid of probabilities.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import documents

# The patterns of the base scan.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "random")

LEAST = 20
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Encodings by pattern, the narrowest first, with the sizes of their alphabets.
ENCODINGS = ((r"^[0-9]+$", 10), (r"^[0-9a-f]+$", 16), (r"^[0-9A-F]+$", 16), (r"^[a-z]+$", 26), (r"^[A-Z]+$", 26), (r"^[A-Z2-7]+=*$", 32), (r"^[A-Za-z0-9+/]+=*$", 64), (r"^[A-Za-z0-9_-]+=*$", 64))
#: Where runs without an encoding are cut: '=' before more text, then '/', then '+'.
CUTS = (r"=+(?=[^=])", "/", r"\+")
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/-_="
COLLISION = 0.075
CHANGES = 0.08
CORRELATION = 0.4
#: Expected share of false discoveries among what the battery reports.
FALSE_SHARE = 1e-4
#: Lower ends of the classes of lengths; the grid of -ln p.
LENGTHS = (20, 24, 32, 48, 64, 128)
GRID, CELLS = 0.25, 400

SPAN = "struct<start:int,kind:int,end:int>"


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _spans(text: Column, pattern: str, found: Column, kind: int, good) -> Column:
    """Places of the matches ``found``: a match starts after the pieces between matches and the matches before it."""
    between = F.split(text, pattern, -1)
    pairs = F.arrays_zip(F.slice(between, 1, F.size(found)).alias("b"), found.alias("m"))
    none = F.array().cast(f"array<{SPAN}>")

    def step(held: Column, pair: Column) -> Column:
        start = held["at"] + F.length(pair["b"])
        end = start + F.length(pair["m"])
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(good(pair["m"]), F.concat(held["spans"], span)).otherwise(held["spans"]).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    return F.when(F.size(found) > 0, F.aggregate(pairs, start, step, lambda held: held["spans"])).otherwise(none)


def _encoded(text: Column) -> Column:
    return text.rlike("|".join(p for p, _ in ENCODINGS))


def _parts(pairs: Column, cut: str) -> Column:
    """Of an array of (span, of): those with an encoding as they are, the others' parts between ``cut`` that are long enough."""

    def cut_up(pair: Column) -> Column:
        seams = F.regexp_extract_all(pair["of"], F.lit(cut), F.lit(0))
        pieces = F.arrays_zip(F.split(pair["of"], cut, -1).alias("p"), seams.alias("m"))
        none = F.array().cast(f"array<struct<span:{SPAN},of:string>>")

        def step(held: Column, piece: Column) -> Column:
            end = held["at"] + F.length(piece["p"])
            part = F.struct(F.struct(held["at"].alias("start"), pair["span"]["kind"].alias("kind"), end.alias("end")).alias("span"), piece["p"].alias("of"))
            return F.struct((end + F.coalesce(F.length(piece["m"]), F.lit(0))).alias("at"), F.when(F.length(piece["p"]) >= LEAST, F.concat(held["parts"], F.array(part))).otherwise(held["parts"]).alias("parts"))

        return F.aggregate(pieces, F.struct(pair["span"]["start"].alias("at"), none.alias("parts")), step, lambda held: held["parts"])

    return F.flatten(F.transform(pairs, lambda p: F.when(_encoded(p["of"]), F.array(p)).otherwise(cut_up(p))))


def _upper_tails(x: Column) -> Column:
    """1 - Phi of each number by the five-term rational approximation of Abramowitz and Stegun, 26.2.17."""

    def tail(u: Column) -> Column:
        t = u["t"]
        part = F.exp(-u["x"] * u["x"] / 2) / math.sqrt(2 * math.pi) * t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
        return F.struct(u["x"].alias("x"), part.alias("p"))

    bound = F.transform(x, lambda v: F.struct(v.alias("x"), (1 / (1 + 0.2316419 * F.abs(v))).alias("t")))
    return F.transform(F.transform(bound, tail), lambda u: F.when(u["x"] >= 0, u["p"]).otherwise(1 - u["p"]))


def _statistics(text: Column) -> Column:
    """Struct of n, k (alphabet), pairs (squared counts, summed), runs, r (serial correlation) of a candidate."""
    body = F.regexp_replace(text, "=+$", "")
    chars = F.split(body, "")
    n = F.length(body).cast("double")
    size = F.coalesce(*(F.when(text.rlike(p), F.lit(k)) for p, k in ENCODINGS))
    pairs = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda s, c: s + F.pow(F.length(body) - F.length(F.replace(body, c, F.lit(""))), F.lit(2)))
    kinds = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(body, "[0-9]+", "0"), "[a-z]+", "a"), "[A-Z]+", "A"), "[+/_=-]+", "+")
    value = lambda c: F.instr(F.lit(ALPHABET), c).cast("double")
    zero = F.struct(*(F.lit(0.0).alias(x) for x in ("last", "s", "ss", "sp", "m")))
    sums = F.aggregate(
        F.transform(chars, value), zero,
        lambda a, v: F.struct(v.alias("last"), (a["s"] + v).alias("s"), (a["ss"] + v * v).alias("ss"), F.when(a["m"] > 0, a["sp"] + a["last"] * v).otherwise(0.0).alias("sp"), (a["m"] + 1).alias("m")),
    )
    return F.struct(n.alias("n"), size.cast("double").alias("k"), pairs.alias("pairs"), F.length(kinds).cast("double").alias("runs"), sums.alias("sums"))


def _moments(s: Column) -> Column:
    """Struct of k, n, chi, runs, and of the mean, variance and lagged product of a candidate's characters."""
    mean = s["sums"]["s"] / s["n"]
    return F.struct(
        s["k"].alias("k"), s["n"].alias("n"), (s["k"] / s["n"] * s["pairs"] - s["n"]).alias("chi"), s["runs"].alias("runs"), mean.alias("mean"),
        (s["sums"]["ss"] / s["n"]).alias("square"), (s["sums"]["sp"] / F.greatest(s["n"] - 1, F.lit(1.0))).alias("lagged"),
    )


def _deviations(m: Column) -> Column:
    """By test, how many deviations a candidate is from prose, towards randomness."""
    n, k = m["n"], m["k"]
    excess = F.greatest(k * COLLISION - 1, F.lit(0.5))
    uniform = (k - 1 + (n - 1) * excess - m["chi"]) / F.sqrt(2 * (k - 1) + 4 * n * excess)
    changes = CHANGES * (n - 1)
    runs = (m["runs"] - 1 - changes - 0.5) / F.sqrt(F.greatest(changes, F.lit(1e-9)))
    variance = m["square"] - m["mean"] * m["mean"]
    r = F.when(variance > 0, (m["lagged"] - m["mean"] * m["mean"]) / variance).otherwise(1.0)
    return F.array(uniform, runs, (CORRELATION - F.abs(r)) * F.sqrt(n))


def _surprises(stats: Column) -> Column:
    """Of an array of (span, s): (span, surprise). Surprise is -ln of the tests' combined probability in prose, 0 without an encoding.

    Each step names what the next uses more than once, which keeps the expression small.
    """
    step = F.transform(stats, lambda p: F.struct(p["span"].alias("span"), _moments(p["s"]).alias("m")))
    known = lambda m: m["k"].isNotNull() & (m["n"] >= LEAST)
    step = F.transform(step, lambda p: F.struct(p["span"].alias("span"), F.when(known(p["m"]), _deviations(p["m"])).alias("z")))
    total = lambda z: F.aggregate(_upper_tails(z), F.lit(0.0), lambda a, q: a - F.ln(F.greatest(q, F.lit(1e-300))))
    step = F.transform(step, lambda p: F.struct(p["span"].alias("span"), total(p["z"]).alias("x")))
    # The upper tail of chi-squared with six degrees at 2x.
    return F.transform(step, lambda p: F.struct(p["span"].alias("span"), F.coalesce(p["x"] - F.ln(1 + p["x"] + p["x"] * p["x"] / 2), F.lit(0.0)).alias("surprise")))


def scanned(docs: DataFrame, name: str = "scan_") -> DataFrame:
    """Adds to ``docs`` two columns, which ``name`` begins: ``base`` (spans by start, then kind) and ``more``: candidates of the battery that no base span meets, with their surprise."""
    text, col = F.coalesce(F.col("text"), F.lit("")), lambda x: F.col(name + x)
    rows = docs.withColumns({
        f"{name}assign": _matches(text, ASSIGN),
        f"{name}access": F.when(F.contains(text, F.lit("AKIA")), _matches(text, ACCESS)).otherwise(F.array().cast("array<string>")),
        f"{name}hex": _matches(text, HEX), f"{name}random": _matches(text, CANDIDATE),
    })
    rows = rows.withColumns({
        f"{name}base": F.array_sort(F.concat(
            _spans(text, ASSIGN, col("assign"), 0, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= ASSIGN_LEAST),
            _spans(text, ACCESS, col("access"), 1, lambda m: F.length(m) >= ACCESS_LEAST),
            _spans(text, HEX, col("hex"), 2, lambda m: F.lit(True)),
        )),
        f"{name}places": _spans(text, CANDIDATE, col("random"), 3, lambda m: F.lit(True)),
    })
    pairs = F.transform(F.arrays_zip(col("places").alias("span"), col("random").alias("of")), lambda p: F.struct(p["span"].alias("span"), p["of"].alias("of")))
    rows = rows.withColumn(f"{name}parts", F.when(F.size(col("random")) > 0, pairs))
    for cut in CUTS:
        whole = ~F.exists(col("parts"), lambda p: ~_encoded(p["of"]))
        rows = rows.withColumn(f"{name}parts", F.when(whole, col("parts")).otherwise(_parts(col("parts"), cut)))
    apart = F.filter(col("parts"), lambda p: ~F.exists(col("base"), lambda b: (b["start"] < p["span"]["end"]) & (p["span"]["start"] < b["end"])))
    stats = F.transform(apart, lambda p: F.struct(p["span"].alias("span"), _statistics(p["of"]).alias("s")))
    empty = F.array().cast(f"array<struct<span:{SPAN},surprise:double>>")
    rows = rows.withColumn(f"{name}more", F.when(F.size(col("random")) > 0, _surprises(stats)).otherwise(empty))
    return rows.drop(*(name + x for x in ("assign", "access", "hex", "random", "places", "parts")))


def _class(length: Column) -> Column:
    return F.expr("0") + sum((length >= x).cast("int") for x in LENGTHS[1:])


def thresholds(rows: DataFrame) -> list[float]:
    """By class of lengths: the least surprise that counts as a discovery, of :func:`scanned` rows.

    In each class the largest p with p x candidates <= FALSE_SHARE x (candidates with at
    most p), on the grid; infinite if there is none.
    """
    # A plain explode() would first filter by the array's size, and so work it out more than once.
    found = rows.select(F.explode_outer("scan_more").alias("x")).filter("x is not null").select(_class(F.col("x.span.end") - F.col("x.span.start")).alias("c"), F.least(F.floor(F.col("x.surprise") / GRID), F.lit(CELLS)).cast("int").alias("cell"))
    counts = {(r["c"], r["cell"]): r["n"] for r in found.groupBy("c", "cell").agg(F.count("*").alias("n")).collect()}  # at most classes x cells rows
    out = []
    for c in range(len(LENGTHS)):
        total, above, least = sum(n for (d, _), n in counts.items() if d == c), 0, math.inf
        for cell in range(CELLS, 0, -1):
            above += counts.get((c, cell), 0)
            if above and math.exp(-cell * GRID) * total <= FALSE_SHARE * above:
                least = cell * GRID
        out.append(least)
    return out


def secrets(docs: DataFrame, name: str = "scan_") -> DataFrame:
    """``docs`` with two more columns, which ``name`` begins: ``base`` and ``all``, arrays of (start, kind, end), in code points, by start, then kind.

    No column of ``docs`` may begin with ``name``; any other may be there. Null texts are
    empty; repeated rows have the same spans; an empty table has none. Texts are scanned
    whole. The corpus is scanned twice: for the false discovery thresholds, and for the result.
    """
    rows = scanned(docs, name)
    least = thresholds(scanned(docs.select("text")))
    limit = F.array(*(F.lit(x) for x in least))
    length = lambda p: p["span"]["end"] - p["span"]["start"]
    good = F.filter(f"{name}more", lambda p: p["surprise"] >= F.get(limit, _class(length(p))))
    return rows.withColumn(f"{name}all", F.array_sort(F.concat(f"{name}base", F.transform(good, lambda p: p["span"])))).drop(f"{name}more")


def joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat(F.get(names, x["kind"]), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; of spans that overlap the first names all."""
    names = F.array(*(F.lit(f"[{k}]") for k in KINDS))

    def step(held: Column, x: Column) -> Column:
        fresh = x["start"] >= held["at"]
        part = F.concat(held["out"], F.substring(text, held["at"] + 1, x["start"] - held["at"]), F.get(names, x["kind"]))
        return F.struct(F.greatest(held["at"], x["end"]).alias("at"), F.when(fresh, part).otherwise(held["out"]).alias("out"))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    done = F.aggregate(spans, start, step, lambda held: F.concat(held["out"], F.substring(text, held["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def op2_randomness_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets(documents(spark, sf_dir).select("doc_id", "text"))
    n = lambda kind: F.size(F.filter("scan_base", lambda x: x["kind"] == kind)).cast("long")
    return rows.select("doc_id", *(n(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])), F.sha2(joined(F.col("scan_base")), 256).alias("base_sha256"), joined(F.col("scan_all")).alias("spans"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: found spans are replaced in the text, n_chars (if there is one) follows; all rows and columns stay, whatever their names."""
    name = "scan_"
    while any(c.lower().startswith(name) for c in docs.columns):
        name = "_" + name
    rows = secrets(docs, name)
    text = redacted(F.col("text"), F.col(f"{name}all"))
    new = {"text": text} | ({"n_chars": F.when(F.size(f"{name}all") > 0, F.length(text).cast("long")).otherwise(F.col("n_chars"))} if "n_chars" in docs.columns else {})
    return rows.withColumns(new).select(*docs.columns)
