"""Secret scan: three fixed patterns and a randomness test battery.

Only DataFrame and SQL functions.  A text's spans are worked out inside its
row (no shuffle of documents): a pattern's matches and the stretches between
them give the positions by running sums.

Battery.  Runs of at least 20 characters of the usual secret alphabets are
candidates.  For the encoding inferred from its characters, each candidate of
length n over an alphabet of k symbols is tested against ordinary text:

* chi-squared: text is far from uniform, with non-centrality lambda * n
  (lambda = k * 0.066 - 1, 0.066 being the repeat rate of letters in prose);
* runs: text changes between lower case, upper case, digits and signs at a
  rate of at most CHANGE_RATE, random strings at the rate of their alphabet;
* serial correlation: neighbouring symbols of text are correlated by at least
  SERIAL in absolute value.

Each gives a normal score, their sum a p-value against "ordinary text".  A
candidate also has to look random: uniformity and independence must not be
rejected at KEEP deviations.  Discoveries are controlled by the step-up rule
at FDR among the different candidates of the same length class, so short
strings, which carry little evidence, don't ride on long ones.  The rule
needs one bounded histogram (length class by p-value bin) over the whole
table; the scan that reports spans then compares with its thresholds.

Null texts count as empty: no spans.  Rows are reported one by one, repeated
or not; columns other than the two named are not read.  An empty table gives
no rows and thresholds that pass nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = (
    r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ACCESS = r"AKIA[A-Z0-9]{16,}"  # 20 characters or more
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}"
KINDS = ("assign", "access", "hex", "random")

FDR = 0.01
KEEP = 4.0
CHANGE_RATE = 0.2
SERIAL = 0.3
LENGTHS = (20, 28, 40, 64)  # lower ends of the length classes
BIN = 0.1  # of -log10 p
BINS = 200
SUM_BLOCK = 256

ENCODINGS = (
    # name, test, alphabet, lambda, rate of class changes if random
    ("hex", "^([0-9a-f]+|[0-9A-F]+)$", "0123456789abcdef", 0.6, 0.469),
    ("base32", "^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 1.11, 0.305),
    ("lower", "^[a-z]+$", "abcdefghijklmnopqrstuvwxyz", 0.72, 0.0),
    ("base62", "^[A-Za-z0-9]+$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", 3.09, 0.622),
    ("base64", "^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 3.22, 0.645),
    ("base64url", "^[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_", 3.22, 0.645),
)


def _running(lengths: Column) -> Column:
    """Sum of the earlier elements at each element, in blocks so that long
    arrays cost little more than their length."""
    zero = F.lit(0).cast("int")
    nothing = F.array().cast("array<int>")

    def starts(values: Column, first: Column) -> Column:
        begin = F.struct(first.alias("at"), nothing.alias("out"))
        step = lambda acc, x: F.struct(
            (acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")
        )
        return F.aggregate(values, begin, step, lambda acc: acc["out"])

    last = F.floor((F.size(lengths) - 1) / SUM_BLOCK).cast("int")
    blocks = F.transform(F.sequence(zero, last), lambda i: F.slice(lengths, i * SUM_BLOCK + 1, SUM_BLOCK))
    sums = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda a, x: a + x))
    return F.flatten(F.zip_with(blocks, starts(sums, zero), starts))


def _matches(df: DataFrame, text: str, pattern: str, out: str) -> DataFrame:
    """Add ``out``: array of (start, token) of the pattern's matches, null if
    there are none."""
    found, between = f"{out}_found", f"{out}_between"
    df = df.withColumn(found, F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    some = F.size(found) > 0
    df = df.withColumn(between, F.when(some, F.split(text, pattern, -1)))
    # what lies before match i: i + 1 stretches between and i matches
    both = F.when(
        some, F.zip_with(F.slice(between, F.lit(1), F.size(found)), F.col(found), lambda b, m: F.struct(F.length(b).alias("b"), F.length(m).alias("m")))
    )
    df = df.withColumn(between, both)
    sums = F.when(some, _running(F.transform(between, lambda x: x["b"] + x["m"])))
    df = df.withColumn(f"{out}_sums", sums)
    spans = F.zip_with(
        F.zip_with(F.col(f"{out}_sums"), F.col(between), lambda s, x: s + x["b"]),
        F.col(found),
        lambda s, m: F.struct(s.alias("start"), m.alias("token")),
    )
    return df.withColumn(out, F.when(some, spans)).drop(found, between, f"{out}_sums")


def _spans(matches: str, kind: int, keep=lambda token: F.lit(True)) -> Column:
    """Array of (start, kind, end) of the matches whose token passes."""
    kept = F.filter(matches, lambda x: keep(x["token"]))
    made = F.transform(
        kept,
        lambda x: F.struct(
            x["start"].alias("start"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["token"])).alias("end")
        ),
    )
    return F.coalesce(made, F.array().cast("array<struct<start:int,kind:int,end:int>>"))


def _upper(x: Column) -> Column:
    """Upper tail of the normal distribution (polynomial of Zelen and Severo)."""
    a = F.abs(x)
    t = 1 / (1 + 0.2316419 * a)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-a * a / 2) * 0.3989422804014327 * poly
    return F.when(x >= 0, tail).otherwise(1 - tail)


def _tested(token: Column, start: Column) -> Column:
    """The battery on one candidate: struct of start, end, p, class and key."""
    bare = F.rtrim(token, F.lit("="))
    n = F.length(bare).cast("double")
    name = F.when(F.lit(False), None)
    for label, test, *_ in ENCODINGS:
        name = name.when(token.rlike(test), F.lit(label))
    # a run of digits only is a number, a mixture of / and _ a path
    name = F.when(token.rlike("^[0-9]+=*$"), None).otherwise(name)
    return F.struct(
        start.alias("start"),
        (start + F.length(token)).alias("end"),
        token.alias("token"),
        n.alias("n"),
        name.alias("encoding"),
        F.when(name == "hex", F.lower(bare)).otherwise(bare).alias("bare"),
    )


def _by_encoding(encoding: Column, values: dict[str, float | str]) -> Column:
    out = F.when(F.lit(False), None)
    for label, value in values.items():
        out = out.when(encoding == label, F.lit(value))
    return out


def _scored(c: Column) -> Column:
    """Statistics of a candidate: squares of symbol counts, class changes and
    sums for the serial correlation."""
    alphabet = _by_encoding(c["encoding"], {e[0]: e[2] for e in ENCODINGS})
    squares = F.aggregate(
        F.split(alphabet, ""),
        F.lit(0.0),
        lambda acc, s: acc + F.pow((F.length(c["bare"]) - F.length(F.replace(c["bare"], s, F.lit("")))).cast("double"), F.lit(2.0)),
    )
    classes = F.translate(c["bare"], "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-", "a" * 26 + "A" * 26 + "0" * 10 + "----")
    runs = F.length(F.regexp_replace(classes, r"(.)\1+", "$1")).cast("double")
    codes = F.transform(F.split(c["bare"], ""), lambda s: F.instr(alphabet, s).cast("double"))
    return F.struct(c.alias("c"), squares.alias("squares"), (runs - 1).alias("changes"), codes.alias("codes"))


def _correlated(x: Column) -> Column:
    codes = x["codes"]
    n = F.size(codes).cast("double")
    mean = F.aggregate(codes, F.lit(0.0), lambda a, v: a + v) / n
    return F.struct(x["c"].alias("c"), x["squares"].alias("squares"), x["changes"].alias("changes"), codes.alias("codes"), mean.alias("mean"))


def _judged(x: Column) -> Column:
    c, mean = x["c"], x["mean"]
    n, enc = c["n"], c["encoding"]
    k = F.length(_by_encoding(enc, {e[0]: e[2] for e in ENCODINGS})).cast("double")
    lam = _by_encoding(enc, {e[0]: e[3] for e in ENCODINGS})
    rate = _by_encoding(enc, {e[0]: e[4] for e in ENCODINGS})
    chi = k / n * x["squares"] - n
    z_chi = ((k - 1 + lam * n) - chi) / F.sqrt(2 * (k - 1 + 2 * lam * n))
    pairs = n - 1
    z_runs = F.when(rate == 0, F.lit(0.0)).otherwise(
        (x["changes"] - pairs * CHANGE_RATE) / F.sqrt(pairs * CHANGE_RATE * (1 - CHANGE_RATE))
    )
    centred = F.transform(x["codes"], lambda v: v - mean)
    spread = F.aggregate(centred, F.lit(0.0), lambda a, v: a + v * v)
    lagged = F.aggregate(
        F.zip_with(F.slice(centred, F.lit(1), F.size(centred) - 1), F.slice(centred, F.lit(2), F.size(centred) - 1), lambda a, b: a * b),
        F.lit(0.0),
        lambda a, v: a + v,
    )
    serial = F.when(spread > 0, lagged / spread).otherwise(1.0)
    z_serial = (F.lit(SERIAL) - F.abs(serial)) * F.sqrt(pairs)
    even = (chi - (k - 1)) / F.sqrt(2 * (k - 1))
    changed = F.when(rate == 0, F.lit(0.0)).otherwise(F.abs(x["changes"] - pairs * rate) / F.sqrt(pairs * rate * (1 - rate)))
    random = (even <= KEEP) & (F.abs(serial) * F.sqrt(n) <= KEEP) & (changed <= KEEP)
    p = F.when(random, _upper((z_chi + z_runs + z_serial) / 3**0.5)).otherwise(1.0)
    length_class = sum((n >= low).cast("int") for low in LENGTHS[1:])
    return F.struct(
        c["start"].alias("start"),
        c["end"].alias("end"),
        c["token"].alias("token"),
        length_class.alias("length_class"),
        # bins from the exact 1.0 down, the last one open
        F.least(F.lit(BINS), F.floor(-F.log10(F.greatest(p, F.lit(1e-300))) / BIN)).cast("int").alias("bin"),
    )


def _candidates(df: DataFrame, text: str, base: str | None) -> DataFrame:
    """Add ``cands``: the tested candidates that overlap no base span."""
    df = _matches(df, text, CANDIDATE, "cands")
    if base:
        df = df.withColumn(
            "cands",
            F.filter(
                "cands",
                lambda x: ~F.exists(base, lambda b: (b["start"] < x["start"] + F.length(x["token"])) & (x["start"] < b["end"])),
            ),
        )
    df = df.withColumn("cands", F.transform("cands", lambda x: _tested(x["token"], x["start"])))
    df = df.withColumn("cands", F.filter("cands", lambda x: x["encoding"].isNotNull() & (x["n"] >= LENGTHS[0])))
    df = df.withColumn("cands", F.transform("cands", _scored))
    df = df.withColumn("cands", F.transform("cands", _correlated))
    return df.withColumn("cands", F.transform("cands", _judged))


def _with_base(df: DataFrame, text: str) -> DataFrame:
    """Add ``base``: spans of the three patterns by start, then kind."""
    for name, pattern in (("m_assign", ASSIGN), ("m_access", ACCESS), ("m_hex", HEX)):
        df = _matches(df, text, pattern, name)
    value = lambda token: F.length(F.regexp_extract(token, ASSIGN, 2)) >= 6
    spans = F.concat(_spans("m_assign", 0, value), _spans("m_access", 1), _spans("m_hex", 2))
    return df.withColumn("base", F.array_sort(spans)).drop("m_assign", "m_access", "m_hex")


def _source(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def thresholds(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", fdr: float = FDR) -> dict[int, int]:
    """Least p-value bin that is a discovery, by length class, from all rows.

    Only the histogram reaches the driver: at most len(LENGTHS) * (BINS + 1)
    rows, whatever the table.
    """
    rows = _candidates(_with_base(_source(df, id_col, text_col), "text"), "text", "base")
    each = rows.filter(F.size("cands") > 0).select(F.explode("cands").alias("c"))
    different = each.select("c.length_class", "c.bin", F.xxhash64("c.token").alias("key")).distinct()
    counts = different.groupBy("length_class", "bin").count().collect()
    least: dict[int, int] = {}
    for k in range(len(LENGTHS)):
        of = {r["bin"]: r["count"] for r in counts if r["length_class"] == k}
        total, passed = sum(of.values()), 0
        for b in range(BINS, -1, -1):
            passed += of.get(b, 0)
            # all p-values of the bin are at most its upper edge
            if passed and 10 ** (-b * BIN) <= fdr * passed / total:
                least[k] = b
    return least


def scan(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: dict[int, int] | None = None, fdr: float = FDR
) -> DataFrame:
    """One row per input row: ``id_col``, base and spans (arrays of start, kind
    and end in code points, end exclusive, by start and kind; kind is the place
    in KINDS).  ``least`` are the thresholds, found from ``df`` if not given."""
    if least is None:
        least = thresholds(df, id_col, text_col, fdr)
    return _scanned(_source(df, id_col, text_col), least).select(F.col("id").alias(id_col), "base", "spans")


def _scanned(rows: DataFrame, least: dict[int, int]) -> DataFrame:
    rows = _candidates(_with_base(rows, "text"), "text", "base")
    passing = F.lit(False)
    chosen = lambda x: sum(
        (((x["length_class"] == k) & (x["bin"] >= b)).cast("int") for k, b in least.items()), F.lit(0)
    ) > 0
    found = F.transform(
        F.filter("cands", chosen if least else lambda x: passing),
        lambda x: F.struct(x["start"].alias("start"), F.lit(3).alias("kind"), x["end"].alias("end")),
    )
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    return rows.withColumn("spans", F.array_sort(F.concat("base", F.coalesce(found, none)))).drop("cands")


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``df`` with every span of its texts replaced by ``mark`` (overlapping
    spans by one); other columns and null texts stay as they are."""
    least = thresholds(df, id_col, text_col)
    columns = df.columns
    source = df.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    begin = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        before = F.substring(F.col("text"), acc["at"] + 1, s["start"] - acc["at"])
        added = F.when(s["start"] >= acc["at"], F.concat(acc["out"], before, F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), added.alias("out"))

    done = _scanned(source, least)
    done = done.withColumn("done", F.when(F.size("spans") > 0, F.aggregate("spans", begin, step)))
    tail = F.substring(F.col("text"), F.col("done.at") + 1, F.length("text"))
    clean = F.when(F.col("done").isNotNull(), F.concat("done.out", tail)).otherwise(F.col(f"row.`{text_col}`"))
    return done.withColumn("clean", clean).select(
        *[(F.col("clean") if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in columns]
    )


def as_text(spans: str) -> Column:
    """kind:start:end, comma-joined."""
    kind = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", kind(x), x["start"].cast("string"), x["end"].cast("string"))))
