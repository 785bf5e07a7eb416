"""Language identification by Bayesian evidence fusion.

Text model: counts of hashed byte trigrams by language over all documents,
added up by grouped aggregation.  A page's visible text gives a log-likelihood
per language (tempered beyond TEXT_TRIGRAMS, since neighbouring trigrams are
not independent).  Three more sources, learned from all pages by grouped
aggregation against the text's own best guess, are added:

* the language the markup declares (P(declared | language));
* the address suffix: top-level label and language-like first path segment
  (P(suffix | language));
* the host prior, smoothed hierarchically: host from domain from top-level
  label from all pages, leaving the page itself out of its host's counts.

The sum, made a distribution, gives the language and its probability.

Null or empty html has no text evidence, a null address no suffix and the
prior of all pages.  Pages without any evidence get that prior.  Null ids and
repeated rows are kept.  Ties go to the language first in the alphabet.
Documents without a language teach nothing; without any the result has null
languages.  Other columns are not read; empty tables give no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aqlens.llm.common import slices, written

BUCKETS = 1 << 14
TEXT_TRIGRAMS = 400
SMOOTH = 0.5
PRIOR_ROWS = 5.0  # weight of the level above, in pages
EVIDENCE_ROWS = 2.0
MOST_LANGUAGES = 1000

HIDDEN = re.compile(r"<(?:(script|style|noscript|template)\b|!--)", re.I)
HIDDEN_END = {k: re.compile(rf"</{k}\s*>", re.I) for k in ("script", "style", "noscript", "template")} | {None: re.compile("-->")}
TAG = re.compile(r"<[^>]*>")
HTML, META = re.compile(r"<html\b[^>]*", re.I), re.compile(r"<meta\b[^>]*", re.I)
LANG = re.compile(r"""\b(?:xml:)?lang\s*=\s*["']?([A-Za-z]{2,3})\b""", re.I)
LANGUAGE = re.compile(r"""content-language["']""", re.I)
CONTENT = re.compile(r"""content\s*=\s*["']?([A-Za-z]{2,3})\b""", re.I)
ADDRESS = re.compile(r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)(?::\d+)?(/[^?#]*)?")
SEGMENT = re.compile(r"^/([a-z]{2})(?:-[A-Za-z]{2})?(?:/|$)")


def shown(page: str) -> str:
    """The page without comments and elements that aren't shown; one that never
    ends hides nothing.  Scanned by position: an end is looked for once where
    it is found, and once a kind where there is none."""
    out, at, pos, endless = [], 0, 0, set()
    while begin := HIDDEN.search(page, pos):
        kind = begin[1] and begin[1].lower()
        end = None if kind in endless else HIDDEN_END[kind].search(page, begin.end())
        if end:
            out += [page[at : begin.start()], " "]
            at = pos = end.end()
        else:
            endless.add(kind)
            pos = begin.end()
    return "".join(out) + page[at:]


def visible(page: str) -> str:
    page = shown(page)
    last = page.rfind(">") + 1  # no tag ends beyond
    return html.unescape(TAG.sub(" ", page[:last]) + page[last:])


def trigrams(text: str) -> np.ndarray:
    """Bucket of every byte trigram of the folded text."""
    data = np.frombuffer(" ".join(text.lower().split()).encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    if len(data) < 3:
        return np.empty(0, np.int64)
    mixed = (data[:-2] << np.uint32(16) | data[1:-1] << np.uint32(8) | data[2:]) * np.uint32(0x9E3779B1)
    return (mixed >> np.uint32(18)).astype(np.int64)


def address(url: str | None) -> tuple[str | None, str | None, str | None, str | None]:
    """host, domain (last two labels), top-level label, suffix evidence."""
    found = ADDRESS.match(url or "")
    if not found:
        return None, None, None, None
    host = found[1].lower().rstrip(".")
    labels = host.split(".")
    segment = SEGMENT.match(found[2] or "")
    return host, ".".join(labels[-2:]), labels[-1], labels[-1] + ("/" + segment[1] if segment else "")


def declared(page: str) -> str | None:
    for tag in HTML.finditer(page):
        if found := LANG.search(tag[0]):
            return found[1].lower()
    for tag in META.finditer(page):
        named = LANGUAGE.search(tag[0])
        if named and (found := CONTENT.search(tag[0], named.end())):
            return found[1].lower()
    return None


def text_model(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities of every bucket, from all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def rows() -> pa.RecordBatch:
            parts = [(k, np.flatnonzero(v), v) for k, v in held.items()]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([k for k, at, _ in parts for _ in at], pa.string()),
                    pa.array(np.concatenate([at for _, at, _ in parts]).astype(np.int32)),
                    pa.array(np.concatenate([v[at] for _, at, v in parts])),
                ],
                names=["lang", "bucket", "n"],
            )

        for batch in batches:
            for part in slices(batch, 1):
                for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    if lang not in held:
                        if len(held) >= 64:
                            yield rows()
                            held.clear()
                        held[lang] = np.zeros(BUCKETS, np.int64)
                    # an empty text still makes its language known
                    held[lang] += np.bincount(trigrams(text.decode("utf-8")), minlength=BUCKETS)
        if held:
            yield rows()

    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("binary").alias("text")).dropna()
    counts = rows.mapInArrow(run, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = written(counts, "lang-counts")
    names = [r["lang"] for r in counts.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(names) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of {lang_col}: not a column of languages")
    names.sort()
    table = np.full((len(names), BUCKETS), SMOOTH)
    for r in counts.collect():  # at most languages times buckets
        table[names.index(r["lang"]), r["bucket"]] += r["n"]
    return names, np.log(table / table.sum(axis=1, keepdims=True))



def identify(
    pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per page: ``id_col``, lang, probability, text_lang, declared, host."""
    names, model = text_model(docs)
    size = len(names)
    shared = pages.sparkSession.sparkContext.broadcast(model)  # bounded: languages times buckets

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, 2):
                out: list[tuple] = []
                for url, raw in zip(part.column(1).to_pylist(), part.column(2).to_pylist()):
                    page = raw.decode("utf-8") if raw else ""
                    at = trigrams(visible(page))
                    score = model[:, at].sum(axis=1) * min(1.0, TEXT_TRIGRAMS / max(1, len(at)))
                    best = int(score.argmax()) if size and len(at) else None
                    out.append((score.tolist(), best, declared(page), *address(url)))
                cols = list(zip(*out))
                kinds = [pa.list_(pa.float64()), pa.int32(), *[pa.string()] * 5]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0)] + [pa.array(c, t) for c, t in zip(cols, kinds)],
                    names=["id", "score", "best", "declared", "host", "domain", "top", "suffix"],
                )

    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").cast("binary").alias("html")
    )
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, score array<double>, best int, declared string, host string, domain string, top string, suffix string"
    seen = written(rows.mapInArrow(read, schema), "lang-pages")
    if not size:
        none = F.lit(None)
        return seen.select(
            F.col("id").alias(id_col), none.cast("string").alias("lang"), none.cast("double").alias("probability"),
            none.cast("string").alias("text_lang"), "declared", "host",
        )

    tally = F.array(*[F.count(F.when(F.col("best") == i, 1)).cast("double") for i in range(size)])
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    total = [float(x) for x in seen.agg(tally.alias("n")).first()["n"]]
    whole = sum(total)
    overall = F.array(*[F.lit((n + 1) / (whole + size)) for n in total])

    # P(evidence | language): counts smoothed by the evidence's share of all pages
    def evidence(column: str) -> DataFrame:
        counts = seen.filter(F.col(column).isNotNull() & F.col("best").isNotNull()).groupBy(column).agg(tally.alias("n"))
        share = (F.aggregate("n", F.lit(0.0), lambda a, x: a + x) + 1) / (whole + 1)
        logs = F.zip_with("n", F.array(*map(F.lit, total)), lambda n, t: F.log((n + share * EVIDENCE_ROWS) / (t + EVIDENCE_ROWS)))
        return written(counts.select(F.col(column).alias(f"{column}_key"), logs.alias(f"{column}_logs")), f"lang-{column}")

    def prior(counts: Column, above: Column) -> Column:
        n = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(counts, above, lambda x, p: (x + PRIOR_ROWS * p) / (n + PRIOR_ROWS))

    hosts = seen.filter("host is not null").groupBy("host", "domain", "top").agg(tally.alias("n"))
    hosts = written(hosts, "lang-hosts")
    add = F.array(*[F.sum(F.col("n")[i]) for i in range(size)])
    domains = hosts.groupBy("domain", "top").agg(add.alias("domain_n"))
    tops = hosts.groupBy("top").agg(add.alias("top_n"))
    above = domains.join(tops, "top").select("domain", prior(F.col("domain_n"), prior(F.col("top_n"), overall)).alias("above"))
    by_host = written(hosts.join(above, "domain").select(F.col("host").alias("host_key"), "n", "above"), "lang-host-priors")

    joined = seen.join(by_host, F.col("host") == F.col("host_key"), "left")
    for column in ("declared", "suffix"):
        joined = joined.join(evidence(column), F.col(column) == F.col(f"{column}_key"), "left")
    own = F.array(*[F.when(F.col("best") == i, F.lit(-1.0)).otherwise(0.0) for i in range(size)])
    zeros = F.array(*[F.lit(0.0)] * size)
    start = F.when(F.col("n").isNull(), overall).otherwise(prior(plus("n", own), F.col("above")))
    fused = plus(plus(plus("score", F.transform("start", lambda x: F.log(x))), F.coalesce("declared_logs", zeros)), F.coalesce("suffix_logs", zeros))
    joined = joined.withColumn("start", start).withColumn("fused", fused)
    top = F.array_max("fused")
    mass = F.aggregate("fused", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    languages = F.array(*map(F.lit, names))
    return joined.select(
        F.col("id").alias(id_col),
        F.element_at(languages, F.array_position("fused", top).cast("int")).alias("lang"),
        (1 / mass).alias("probability"),
        F.when(F.col("best").isNotNull(), F.element_at(languages, F.col("best") + 1)).alias("text_lang"),
        "declared",
        "host",
    )
