"""Secret scans by pattern and by a battery of randomness tests.

Three kinds come from fixed patterns: ``assign`` (a keyword, a separator and a value), ``access`` (access
key ids) and ``hex`` (long runs of hex digits). The kind ``random`` comes from the battery. Its candidates
are maximal runs of encoding characters, their pieces between ``=`` and ``/``, and the pieces of those between ``-``
and ``_``. Each gets an inferred encoding: hex, base32 or base36 if it is one without its dashes and in one case,
else base64. Against the hypothesis of an ordinary token (word, identifier, path, number) of that encoding:

* chi-squared uniformity: the statistic over the alphabet, far below what the skewed letters of ordinary
  tokens give;
* runs: the number of runs of one character class, far above that of ordinary tokens;
* serial correlation of neighbouring alphabet positions, nearer to 0 than in ordinary tokens;
* class fit: the chi-squared statistic over the shares of character classes, far below that of ordinary tokens.

One-sided tail bounds of the four combine by Fisher's method to a p-value. Candidates form strata by
encoding and length (powers of 2), and Benjamini-Hochberg within each stratum over the whole corpus
bounds the share of false finds for short and long tokens alike. P-values are rounded up to steps
of exp(-0.1), so a stratum is judged from a small histogram. A find within another find is left out.

All of it is DataFrame expressions within the row; only histograms are shuffled, and only the
thresholds (one number a stratum: at most ``MAX_STRATA``) come back, as a scalar subquery.

Positions are code points. A null text is empty; empty texts and tables give no spans; rows that repeat
an id are scanned row by row. Columns beside the named ones are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Fixed patterns of the contract.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Kinds in the order of the contract, pattern, group that is measured, its least length.
KINDS = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16))
#: What a text must hold for its kind to be worth an exact scan.
NEEDS = {"assign": ASSIGN, "access": r"AKIA[A-Z0-9]{14}", "hex": r"[0-9a-f]{16}", "random": r"[A-Za-z0-9+/_=-]{20}"}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
PIECE = 20
ALPHABETS = {"hex": "0123456789abcdef", "base32": "abcdefghijklmnopqrstuvwxyz234567",
             "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
             "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
#: Encodings of one case, without dashes, and what infers them, first to last; all else is base64.
INFERRED = (("hex", "^([0-9a-f]+|[0-9A-F]+)$"), ("base32", "^([a-z2-7]+|[A-Z2-7]+)$"), ("base36", "^([a-z0-9]+|[A-Z0-9]+)$"))
#: Chance that two characters of an ordinary token agree, by encoding.
AGREE = {"hex": 0.12, "base32": 0.10, "base36": 0.07, "base64": 0.065}
#: Chance that an ordinary token changes its character class from one character to the next, by encoding
#: (identifiers in camel case and paths change often).
CHANGE = {"hex": 0.15, "base32": 0.06, "base36": 0.12, "base64": 0.30}
#: Shares of lower case, upper case and other characters in random tokens, by encoding; those of one case are lowered first.
CLASSES = {"hex": (6 / 16, 0.0, 10 / 16), "base32": (26 / 32, 0.0, 6 / 32), "base36": (26 / 36, 0.0, 10 / 36),
           "base64": (26 / 64, 26 / 64, 12 / 64)}
#: The chi-squared statistic over these classes, by character, of ordinary tokens: mean and deviation.
MISFIT = {"hex": (0.45, 0.20), "base32": (0.17, 0.08), "base36": (0.25, 0.12), "base64": (0.80, 0.25)}
#: Characters without padding that the tests need.
LEAST = 16
#: Serial correlation of ordinary tokens.
SERIAL = 0.4
#: Share of false finds that each stratum allows.
ALPHA = 0.01
#: Encodings times powers of 2 that a string's length can reach.
MAX_STRATA = 4 * 32

RUN = "struct<at:int,tok:string>"
SPAN = "struct<start:int,end:int,rank:int>"
CAND = "struct<start:int,end:int,stratum:string,score:int>"
RANKS = {"assign": 0, "access": 1, "hex": 2, "random": 3}


def _needs(kind: str) -> Column:
    return F.col("_t").rlike(NEEDS[kind])


def _places(pattern: str, group: int, least: int, rank: int, kind: str) -> Column:
    """The spans of a kind: the lengths of the matches and of the pieces between them add up to positions."""
    found = F.regexp_extract_all("_t", F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all("_t", F.lit(pattern), F.lit(group))
    between = F.split("_t", pattern, -1)
    parts = F.zip_with(F.slice(between, F.lit(1), F.size(found)), F.arrays_zip(found.alias("m"), value.alias("v")),
                       lambda b, x: F.struct(F.length(b).alias("gap"), F.length(x["m"]).alias("n"),
                                             F.length(x["v"]).alias("v")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        span = F.array(F.struct(begin.alias("start"), (begin + x["n"]).alias("end"), F.lit(rank).alias("rank")))
        return F.struct((begin + x["n"]).alias("at"),
                        F.when(x["v"] >= least, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate(parts, start, step, lambda acc: acc["spans"])
    return F.when(_needs(kind), spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def _tail(z: Column) -> Column:
    """-ln of an upper bound of the normal tail beyond z: exp(-z*z/2)/2 for z >= 0."""
    half = 0.5 * F.exp(-z * z / 2)
    return F.when(z >= 0, z * z / 2 + 0.6931471805599453).otherwise(-F.log(1 - half))


def token_score(token: Column) -> Column:
    """struct(stratum, score) of a candidate token; score is -10 ln p, rounded down. The tests read the token without
    padding at its ends, and in encodings of one case without dashes and lowered; if under ``LEAST`` characters
    remain, the score is 0."""
    token = F.trim(token, F.lit("="))

    def by(enc: Column, values: dict) -> Column:
        return F.coalesce(*(F.when(enc == e, F.lit(v)) for e, v in values.items()))

    def inferred(x: Column) -> Column:
        bare = F.translate(x["tok"], "-_", "")
        enc = F.coalesce(*(F.when(bare.rlike(pattern), F.lit(e)) for e, pattern in INFERRED), F.lit("base64"))
        return F.struct(x["tok"].alias("tok"), bare.alias("bare"), enc.alias("enc"))

    def spelt(x: Column) -> Column:
        """The token in its encoding's alphabet, the encoding, its alphabet as one string."""
        tok = F.when(x["enc"] == "base64", F.translate(x["tok"], "-_", "+/")).otherwise(F.lower(x["bare"]))
        return F.struct(tok.alias("tok"), x["enc"].alias("enc"), by(x["enc"], ALPHABETS).alias("abc"))

    def measured(x: Column) -> Column:
        chars = F.split(x["tok"], "")
        index = F.transform(F.filter(chars, lambda c: c != ""), lambda c: F.instr(x["abc"], c).cast("double"))
        runs = F.size(F.regexp_extract_all(x["tok"], F.lit("[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+"), F.lit(0)))
        misfit = F.lit(0.0)
        for place, cls in enumerate(("[^a-z]", "[^A-Z]", "[a-zA-Z]")):
            seen = F.length(F.regexp_replace(x["tok"], cls, "")).cast("double")
            mean = F.length(x["tok"]) * by(x["enc"], {e: c[place] for e, c in CLASSES.items()})
            misfit = misfit + F.when(mean > 0, F.pow(seen - mean, 2) / mean).otherwise(F.lit(0.0))
        return F.struct(x["enc"].alias("enc"), F.length(x["abc"]).cast("double").alias("k"), index.alias("i"),
                        F.greatest(F.size(index).cast("double"), F.lit(2.0)).alias("n"), runs.cast("double").alias("runs"), misfit.alias("misfit"))

    def sums(x: Column) -> Column:
        n, zero = x["n"], F.lit(0.0)
        squares = F.aggregate(F.transform(F.sequence(F.lit(1), x["k"].cast("int")), lambda s: F.pow(F.size(F.filter(
            x["i"], lambda c: c == s)).cast("double"), 2)), zero, lambda a, b: a + b)
        mean = F.aggregate(x["i"], zero, lambda a, b: a + b) / n
        return F.struct(x["enc"].alias("enc"), x["k"].alias("k"), n.alias("n"), x["runs"].alias("runs"), x["i"].alias("i"),
                        x["misfit"].alias("misfit"),
                        squares.alias("squares"), mean.alias("mean"))

    def correlated(x: Column) -> Column:
        zero = F.lit(0.0)
        var = F.aggregate(x["i"], zero, lambda a, b: a + F.pow(b - x["mean"], 2))
        cov = F.aggregate(F.zip_with(F.slice(x["i"], F.lit(1), x["n"].cast("int") - 1), F.slice(x["i"], F.lit(2), x["n"].cast(
            "int") - 1), lambda a, b: (a - x["mean"]) * (b - x["mean"])), zero, lambda a, b: a + b)
        return F.struct(x["enc"].alias("enc"), x["k"].alias("k"), x["n"].alias("n"), x["runs"].alias("runs"),
                        x["misfit"].alias("misfit"), (x["k"] * x["squares"] / x["n"] - x["n"]).alias("chi2"),
                        F.when(var > 0, F.abs(cov / var)).otherwise(F.lit(1.0)).alias("serial"))

    def scored(x: Column) -> Column:
        n, k = x["n"], x["k"]
        agree, change = by(x["enc"], AGREE), by(x["enc"], CHANGE)
        expected = k * (1 + (n - 1) * agree) - n
        deviation = k * (n - 1) * F.sqrt(2 * agree * (1 - agree) / (n * (n - 1)) + 0.012 / n)
        uniform = (expected - x["chi2"]) / deviation
        runs = (x["runs"] - 1 - (n - 1) * change) / F.sqrt((n - 1) * change * (1 - change))
        serial = (SERIAL - x["serial"]) * F.sqrt(n)
        fit = (by(x["enc"], {e: m for e, (m, _) in MISFIT.items()}) - x["misfit"] / n) / by(
            x["enc"], {e: d for e, (_, d) in MISFIT.items()})
        half = _tail(uniform) + _tail(runs) + _tail(serial) + _tail(fit)
        log_p = half - F.log(1 + half + half * half / 2 + half * half * half / 6)
        return F.struct(F.concat(x["enc"], F.lit(":"), F.floor(F.log2(n)).cast("string")).alias("stratum"),
                        F.when(n < LEAST, F.lit(0)).otherwise(
                            F.floor(10 * F.greatest(log_p, F.lit(0.0))).cast("int")).alias("score"))

    # each step is an array of one element, so that its value is made once and named in the next lambda
    box = F.array(F.struct(token.alias("tok")))
    for f in (inferred, spelt, measured, sums, correlated, scored):
        box = F.transform(box, f)
    return F.get(box, F.lit(0))


def _pieces(run: Column, separator: str) -> Column:
    """The pieces of a run (at, tok) between separators of one character, as long as a candidate."""
    start = F.struct(run["at"].alias("at"), F.array().cast(f"array<{RUN}>").alias("found"))

    def step(acc: Column, p: Column) -> Column:
        one = F.array(F.struct(acc["at"].alias("at"), p.alias("tok")))
        return F.struct((acc["at"] + F.length(p) + 1).alias("at"), F.when(
            F.length(p) >= PIECE, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(F.split(run["tok"], separator, -1), start, step, lambda acc: acc["found"])


def _candidates() -> Column:
    """Candidate tokens with their place, stratum and score."""
    found = F.regexp_extract_all("_t", F.lit(CANDIDATE), F.lit(0))
    between = F.split("_t", CANDIDATE, -1)
    parts = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda b, m: F.struct(
        F.length(b).alias("gap"), m.alias("tok")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{RUN}>").alias("found"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        one = F.array(F.struct(begin.alias("at"), x["tok"].alias("tok")))
        return F.struct((begin + F.length(x["tok"])).alias("at"), F.concat(acc["found"], one).alias("found"))

    def outer(r: Column) -> Column:
        divided = F.trim(r["tok"], F.lit("=")).rlike("[=/]")
        return F.when(divided, F.concat(F.array(r), _pieces(r, "[=/]"))).otherwise(F.array(r))

    def inner(r: Column) -> Column:
        divided = ~F.trim(r["tok"], F.lit("=")).rlike("[=/]") & F.trim(r["tok"], F.lit("-_")).rlike("[-_]")
        return F.when(divided, F.concat(F.array(r), _pieces(r, "[-_]"))).otherwise(F.array(r))

    runs = F.aggregate(parts, start, step, lambda acc: acc["found"])
    for pieces in (outer, inner):
        runs = F.flatten(F.transform(runs, pieces))
    scored = F.transform(runs, lambda r: F.struct(r["at"].alias("start"), (r["at"] + F.length(r["tok"])).alias("end"),
                                                  token_score(r["tok"]).alias("s")))
    cands = F.transform(scored, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["s"]["stratum"].alias(
        "stratum"), c["s"]["score"].alias("score")))
    return F.when(_needs("random"), cands).otherwise(F.array().cast(f"array<{CAND}>"))


def scanned(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``_base`` (spans of the pattern kinds) and ``_cands`` (scored candidates); row by row."""
    df = df.withColumn("_t", F.coalesce(F.col(text), F.lit("")))
    base = F.concat(*(_places(p, g, n, RANKS[k], k) for k, p, g, n in KINDS))
    return df.withColumn("_base", base).withColumn("_cands", _candidates()).drop("_t")


def stored_scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """The scan without the texts, stored: finds and candidates are read twice, texts once."""
    return stored(scanned(docs, text).drop(text))


def thresholds(found: DataFrame, alpha: float = ALPHA) -> Column:
    """Least score of a find by stratum, as a scalar map: Benjamini-Hochberg over the strata's histograms."""
    hist = found.select(F.explode("_cands").alias("c")).groupBy("c.stratum", "c.score").agg(F.count(F.lit(1)).alias("n"))
    every = Window.partitionBy("stratum")
    above = every.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hist = hist.withColumn("m", F.sum("n").over(every)).withColumn("above", F.sum("n").over(above))
    least = hist.where(F.exp(-F.col("score") / 10) <= alpha * F.col("above") / F.col("m")).groupBy("stratum").agg(
        F.min("score").alias("least"))
    return least.agg(F.map_from_entries(F.collect_list(F.struct("stratum", "least")))).scalar()


def with_spans(found: DataFrame, least: Column) -> DataFrame:
    """Adds ``spans``: all finds as struct(start, end, rank), sorted; rank is the kind's place in the order."""
    found = found.withColumn("_least", least)
    kept = F.transform(F.filter("_cands", lambda c: F.coalesce(c["score"] >= F.try_element_at(
        F.col("_least"), c["stratum"]), F.lit(False))), lambda c: F.struct(
            c["start"].alias("start"), (-c["end"]).alias("back")))
    none = F.struct(F.lit(0).alias("reach"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def outer(acc: Column, c: Column) -> Column:
        """Finds overlap only when one holds the other; the longest of those that start together comes first."""
        end = -c["back"]
        span = F.array(F.struct(c["start"].alias("start"), end.alias("end"), F.lit(RANKS["random"]).alias("rank")))
        return F.struct(F.greatest(acc["reach"], end).alias("reach"),
                        F.when(end > acc["reach"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    whole = F.aggregate(F.array_sort(kept), none, outer, lambda acc: acc["spans"])
    by_rank = F.transform(F.concat("_base", whole), lambda s: F.struct(
        s["start"].alias("start"), s["rank"].alias("rank"), s["end"].alias("end")))
    return found.withColumn("spans", F.array_sort(by_rank)).drop("_least", "_base", "_cands")


def spelled(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*(F.lit(k) for k in RANKS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"].cast(
        "string"), s["end"].cast("string"))), ",")


def masked(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every maximal run of overlapping spans replaced by ``mark``."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.array(F.concat(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark)))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(s["start"] >= acc["at"], F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    # a span that only touches the one before it starts a mark of its own
    whole = F.aggregate(spans, start, step, lambda acc: F.concat(
        F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The documents with every find masked in ``text`` and ``n_chars``, where there is one, set anew. The texts are scanned
    once: the scan is stored beside the rows, and its candidates give the thresholds before the masks are made."""
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}  # names that none of the scan's can clash with
    found = stored(scanned(docs.toDF(*at.values()), at["text"]))
    out = with_spans(found, thresholds(found.select("_cands")))
    text = F.col(at["text"])
    masks = F.when(text.isNotNull(), masked(text, F.col("spans"), mark))
    out = out.withColumn("_masked", masks)
    new = {c: F.col(n) for c, n in at.items()} | {"text": F.col("_masked")}
    if "n_chars" in at:
        new["n_chars"] = F.when(F.size("spans") > 0, F.length("_masked")).otherwise(F.col(at["n_chars"])).cast(
            docs.schema["n_chars"].dataType)
    return out.select(*(c.alias(n) for n, c in new.items()))
