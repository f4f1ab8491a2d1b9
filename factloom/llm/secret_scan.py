"""Secret scans, with DataFrame functions alone.

Base spans are assignments to password-like names, access keys and long lower-case hexadecimal runs. The
method adds ``random`` spans: runs of at least 20 encoding characters that look uniformly random.
For each candidate an encoding is inferred (hexadecimal, base32 or base64, by its characters and by the
character kinds it must mix), its characters become numbers 0..k-1, and a battery of three tests is made:

* chi-squared uniformity of the alphabet, in as many equal bins as the length supports: the most of 64, 32, 16 or 8, up to
  the alphabet's size, that leaves ``EXPECTED`` characters a bin, else four (one degree of freedom less than bins),
* runs above and below the middle of the alphabet (Wald-Wolfowitz, normal score),
* serial correlation of neighbours (normal score).

Fisher's method combines the three p-values (6 degrees of freedom, a closed form). Random strings have uniform
combined p-values and ordinary words small ones. For every class of encoding and length, a histogram of the whole
corpus' distinct tokens (copies of one are one draw) estimates how many of the candidates above a level are random:
twice the number above one half, as far as they are uniform, times one less the level. The lowest level at which the others
make up at most ``FALSE_RATE`` of what is accepted is the class's threshold; a class in which no level reaches that accepts
nothing. Candidates and their p-values are computed once for each row and kept in a checkpoint.

Defined results: null text counts as empty and has no span; texts of any length are scanned whole, in time that grows with
length times the square root of the number of matches; a null doc_id is kept; rows pass one by one, repeated rows included,
and equal texts get equal spans; an empty table gives an empty result; columns besides doc_id and text are ignored, whatever
their names. Spans count code points, the end excluded; all kinds may overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import checkpointed, guarded_spans, let, places, spans_of_kind, spans_text

KINDS = ["assign", "access", "hex", "random"]
#: Fixed values of the contract.
NAMES = r"(?i:password|passwd|secret|token|api_?key)"
ASSIGN = NAMES + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
FALSE_RATE, LEVELS = 0.05, 50
#: Characters a bin of the chi-squared test must expect.
EXPECTED = 5
#: A candidate starts where its run of characters starts, so a long run is scanned once; an equals sign is no part of the
#: run, so the value of NAME=value is one.
CANDIDATE = r"(?:\G|(?<![A-Za-z0-9+/_-]))[A-Za-z0-9+/_-]{20,}+={0,2}+"
#: Alphabet of each encoding, in the order of its values; base64 takes both forms of its last two characters.
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}


def base_spans(text: Column) -> Column:
    """array<struct<s, k, e, v>> of the base kinds, ``v`` being the matched text."""
    text = F.coalesce(text, F.lit(""))
    assign = guarded_spans(text, ASSIGN, ASSIGN, 0, lambda _, value: F.length(value) >= 6, group=1)
    access = guarded_spans(text, ACCESS, ACCESS, 1, lambda *_: F.lit(True))
    hexes = guarded_spans(text, HEX, HEX, 2, lambda *_: F.lit(True))
    return F.concat(assign, access, hexes)


def encoding_of(token: Column) -> Column:
    """hex, base32 or base64 where the token has the characters and the mixture of kinds of one; else null."""
    return (
        F.when(token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$") & token.rlike("[0-9]") & token.rlike("[A-Fa-f]"), F.lit("hex"))
        .when(token.rlike("^[A-Z2-7]+=*$") & token.rlike("[2-7]") & token.rlike("[A-Z]"), F.lit("base32"))
        .when(token.rlike("^[A-Za-z0-9+/_-]+=*$") & token.rlike("[0-9]") & token.rlike("[A-Z]") & token.rlike("[a-z]"), F.lit("base64"))
    )


def _plain(token: Column, kind: Column) -> Column:
    """A token in one of the forms its encoding leaves open: lower case, no padding, one pair of last characters."""
    return F.when(kind == "hex", F.lower(token)).otherwise(F.translate(F.rtrim(token, F.lit("=")), "-_", "+/"))


def _values(token: Column, kind: Column) -> Column:
    """A token's characters as numbers of its alphabet."""
    plain = _plain(token, kind)
    alphabet = F.lit(ALPHABETS["base64"])
    for name in ("hex", "base32"):
        alphabet = F.when(kind == name, F.lit(ALPHABETS[name])).otherwise(alphabet)
    return F.transform(F.split(plain, ""), lambda c: F.call_function("instr", alphabet, c) - 1)


def normal_tail(z: Column) -> Column:
    """P(|Z| > z) for z >= 0 by the rational approximation 7.1.26 of Abramowitz and Stegun (error below 2e-7)."""
    x = z / 1.4142135623730951
    poly = F.lit(0.0)
    for c in (1.061405429, -1.453152027, 1.421413741, -0.284496736, 0.254829592):
        poly = (poly + c) / (1 + 0.3275911 * x)
    return F.greatest(poly * F.exp(-x * x), F.lit(1e-300))


def chi_tail(root: Column, bins: Column) -> Column:
    """P(chi-squared with ``bins`` - 1 degrees of freedom > root squared), for an even number of bins.

    Odd degrees of freedom have a closed form: twice the normal tail plus the density times a sum of (bins - 2) / 2 terms,
    each the one before times root squared over the next odd number. Beyond 37 the tail is below the floor.
    """

    def summed(x: Column) -> Column:
        def step(state: Column, r: Column) -> Column:
            term = F.when(r == 1, x).otherwise(state["term"] * x * x / (2 * r - 1))
            return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"))

        start = F.struct(F.lit(0.0).alias("term"), F.lit(0.0).alias("sum"))
        series = F.aggregate(F.sequence(F.lit(1), F.floor(bins / 2).cast("int") - 1), start, step, lambda state: state["sum"])
        return F.greatest(normal_tail(x) + 0.7978845608028654 * series * F.exp(-x * x / 2), F.lit(1e-300))

    return F.when(root > 37, F.lit(1e-300)).otherwise(let(F.least(root, F.lit(37.0)), summed))


def bins_of(n: Column, size: Column) -> Column:
    """Bins of the chi-squared test for a token of n characters of an alphabet of the given size."""
    most = F.lit(4)
    for bins in (8, 16, 32, 64):
        most = F.when((size >= bins) & (n >= bins * EXPECTED), F.lit(bins)).otherwise(most)
    return most


def battery(token: Column, kind: Column) -> Column:
    """The combined p-value of the three tests for a token of an inferred encoding."""
    size = F.when(kind == "hex", 16).when(kind == "base32", 32).otherwise(64)

    def counted(x: Column) -> Column:
        v, k = x["v"], x["k"]
        high = F.size(F.filter(v, lambda c: c * 2 >= k)).cast("double")
        pairs = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b"), ((a * 2 >= k) != (b * 2 >= k)).alias("turn")))
        mean = F.aggregate(v, F.lit(0.0), lambda a, c: a + c) / F.size(v)
        return F.struct(v.alias("v"), k.alias("k"), bins_of(F.size(v), k).alias("bins"), F.size(v).cast("double").alias("n"), high.alias("high"), pairs.alias("pairs"), mean.alias("mean"))

    def binned(x: Column) -> Column:
        # The sum of the squared counts: in sorted order the r-th value of a bin adds 2r - 1 to it.
        def step(state: Column, c: Column) -> Column:
            run = F.when(c == state["bin"], state["run"] + 1).otherwise(F.lit(1))
            return F.struct(c.alias("bin"), run.alias("run"), (state["squares"] + 2.0 * run - 1).alias("squares"))

        values = F.sort_array(F.transform(x["v"], lambda c: F.floor(c * x["bins"] / x["k"]).cast("int")))
        start = F.struct(F.lit(-1).alias("bin"), F.lit(0).alias("run"), F.lit(0.0).alias("squares"))
        squares = F.aggregate(values, start, step, lambda state: state["squares"])
        return F.struct(*[x[name].alias(name) for name in ("v", "n", "bins", "high", "pairs", "mean")], F.greatest(squares * x["bins"] / x["n"] - x["n"], F.lit(0.0)).alias("chi"))

    def summed(x: Column) -> Column:
        runs = 1 + F.size(F.filter(x["pairs"], lambda p: p["turn"])).cast("double")
        expected = 1 + 2 * x["high"] * (x["n"] - x["high"]) / x["n"]
        square = F.aggregate(x["v"], F.lit(0.0), lambda a, c: a + (c - x["mean"]) * (c - x["mean"]))
        product = F.aggregate(x["pairs"], F.lit(0.0), lambda a, p: a + (p["a"] - x["mean"]) * (p["b"] - x["mean"]))
        return F.struct(x["n"].alias("n"), x["bins"].alias("bins"), x["chi"].alias("chi"), runs.alias("runs"), expected.alias("expected"), square.alias("square"), product.alias("product"))

    def scored(x: Column) -> Column:
        spread = (x["expected"] - 1) * (x["expected"] - 2) / (x["n"] - 1)
        runs_z = F.when(spread > 0, (x["runs"] - x["expected"]) / F.sqrt(spread)).otherwise(F.lit(30.0))
        serial_z = F.when(x["square"] > 0, (x["product"] / x["square"] + 1 / x["n"]) * F.sqrt(x["n"])).otherwise(F.lit(30.0))
        return F.struct(F.sqrt(x["chi"]).alias("chi"), x["bins"].alias("bins"), F.abs(runs_z).alias("runs"), F.abs(serial_z).alias("serial"))

    def tails(z: Column) -> Column:
        return -(F.log(chi_tail(z["chi"], z["bins"])) + F.log(normal_tail(z["runs"])) + F.log(normal_tail(z["serial"])))

    def fisher(half: Column) -> Column:
        return F.exp(-half) * (1 + half + half * half / 2)

    start = F.struct(_values(token, kind).alias("v"), size.alias("k"))
    return let(let(let(let(let(let(start, counted), binned), summed), scored), tails), fisher)


def length_class(n: Column) -> Column:
    return F.when(n < 24, 0).when(n < 32, 1).when(n < 48, 2).when(n < 96, 3).otherwise(4)


def candidates(text: Column) -> Column:
    """array<struct<s, k, e, group, p, key>> of the tokens with an inferred encoding; ``key`` is a digest of the token."""
    text = F.coalesce(text, F.lit(""))
    spans = guarded_spans(text, r"[A-Za-z0-9+/_-]{20}", CANDIDATE, 3, lambda m, _: encoding_of(m).isNotNull())

    def named(x: Column) -> Column:
        return F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), x["v"].alias("token"), encoding_of(x["v"]).alias("kind"))

    def tested(x: Column) -> Column:
        group = F.concat_ws("/", x["kind"], length_class(x["e"] - x["s"]).cast("string"))
        return F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"), group.alias("group"), battery(x["token"], x["kind"]).alias("p"), F.md5(_plain(x["token"], x["kind"]).cast("binary")).alias("key"))

    return F.transform(F.transform(spans, named), tested)


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, base, tokens): base spans and scored candidates of every row, checkpointed; the texts are read once."""
    return checkpointed(docs.select(F.col("doc_id").cast("long"), places(base_spans(F.col("text"))).alias("base"), candidates(F.col("text")).alias("tokens")))


def thresholds(rows: DataFrame, false_rate: float = FALSE_RATE) -> dict[str, float]:
    """The least accepted combined p-value of each class of encoding and length, from the distinct tokens of all ``scanned`` rows.

    A token has one p-value and so one level. The driver gets ``LEVELS`` counts for each of at most fifteen classes.
    """
    found = rows.select(F.explode("tokens").alias("x"))
    level = F.least(F.floor(F.col("x.p") * LEVELS), F.lit(LEVELS - 1)).cast("int")
    distinct = found.select(F.col("x.group").alias("group"), level.alias("level"), F.col("x.key").alias("key")).distinct()
    counted = distinct.groupBy("group", "level").count().collect()
    histograms: dict[str, list[int]] = {}
    for group, at, n in counted:
        histograms.setdefault(group, [0] * LEVELS)[at] = n
    out = {}
    for group, h in histograms.items():
        random = 2 * sum(h[LEVELS // 2 :])
        for at in range(LEVELS):
            accepted = sum(h[at:])
            if accepted and accepted - min(accepted, random * (1 - at / LEVELS)) <= false_rate * accepted:
                out[group] = at / LEVELS
                break
    return out


def scan(docs: DataFrame, false_rate: float = FALSE_RATE) -> DataFrame:
    """(doc_id, spans) with spans array<struct<s, k, e>>: base spans and the method's."""
    rows = scanned(docs)
    levels = thresholds(rows, false_rate)
    if not levels:
        return rows.select("doc_id", F.col("base").alias("spans"))
    least = F.create_map(*[F.lit(x) for pair in sorted(levels.items()) for x in pair])
    good = F.filter("tokens", lambda x: x["p"] >= F.coalesce(F.element_at(least, x["group"]), F.lit(2.0)))
    return rows.select("doc_id", F.concat("base", places(good)).alias("spans"))


def op7_secrets(spark, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda x: x["k"] < 3)
    return found.select(
        "doc_id",
        spans_of_kind(F.col("spans"), 0).alias("n_assign"),
        spans_of_kind(F.col("spans"), 1).alias("n_access"),
        spans_of_kind(F.col("spans"), 2).alias("n_hex"),
        F.sha2(spans_text(base, KINDS).cast("binary"), 256).alias("base_sha256"),
        spans_text(F.col("spans"), KINDS).alias("spans"),
    )
