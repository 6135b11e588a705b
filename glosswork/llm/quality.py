"""Quality classifier: document evidence combined with host and path posteriors (hierarchical empirical Bayes).

1. A logistic model over surface features (symbol, shout, table, repetition rates; vectorised over Arrow batches) and
   the hashed distinct words of the whole text is fitted on a bounded sample of labelled documents. A document is good
   only if its quality is 1 and it isn't toxic.
2. Every document gives evidence to its host and to its path on the host: the classifier's probability, for labelled
   documents too, so a label moves a site only through the classifier. Grouped aggregation sums the evidence over all
   documents.
3. The prior strength of each level is estimated by moments from the spread of the site means; a path is shrunk
   toward its host and a host toward the global mean, the document's own evidence left out.
4. posterior logit = classifier logit + logit(path posterior) - logit(global mean).

Defined cases. Null or empty text: no evidence of its own (classifier logit = prior logit), so the site decides.
Null source or language: they form a site of their own. Null labels are no labels (toxic
alone makes a document bad, a null there doesn't); a document labelled twice counts the mean of its labels, and of several rows of a labelled id one is learnt from. Empty documents: an empty result. No labels or only one class: the classifier is
constant at the smoothed mean of what there is (0.5 with none) and everything at or above the threshold is kept.
Repeated rows are scored alike and each counts. Extra columns of any name pass through keep().
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, batches, cut, fresh, read, session, stored

#: Most labelled documents that the classifier is fitted on (taken by hash order).
MAX_LABELLED = 6000
THRESHOLD = 0.5
#: Surface rates, buckets of hashed words, and both.
SURFACE = 8
BUCKETS = 1 << 20
FEATURES = SURFACE + BUCKETS
#: Ridge of a word's weight, divided by how surely the word goes with the label (its G).
WORD_RIDGE = 3.0


def buckets(text: str) -> list[int]:
    """The bucket of each distinct word of the whole text."""
    return sorted(xxhash.xxh3_64_intdigest(x) % BUCKETS for x in set(WORD.findall(text.lower())))


def features(texts: list[str]) -> np.ndarray:
    """One dense row a text: surface() and the distinct words by bucket. For a few texts; logits() is the sparse form."""
    out = np.zeros((len(texts), FEATURES))
    out[:, :SURFACE] = surface(texts)
    for row, t in zip(out, texts):
        np.add.at(row, np.array(buckets(t), np.int64) + SURFACE, 1)
    return out


class Weights(dict):
    """word -> weight of its bucket, filled on use."""

    def __init__(self, ids: np.ndarray, w: np.ndarray):
        super().__init__()
        self.at = dict(zip(ids.tolist(), w.tolist()))

    def __missing__(self, word: str) -> float:
        x = self[word] = self.at.get(xxhash.xxh3_64_intdigest(word) % BUCKETS, 0.0)
        return x


def logits(texts: list[str], w: np.ndarray, words: Weights) -> np.ndarray:
    """features(texts) @ w[:-1] + w[-1]; w: the surface weights and the intercept. Exact sums, whatever a set's order."""
    if len(words) > 1_000_000:
        words.clear()
    return surface(texts) @ w[:-1] + w[-1] + np.array([math.fsum(map(words.__getitem__, set(WORD.findall(t.lower())))) for t in texts])


def surface(texts: list[str]) -> np.ndarray:
    """One row of rates a text, all in about [0, 1], from byte histograms and sets of words and lines."""
    raw = [t.encode() for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    flat = np.frombuffer(b"".join(raw), np.uint8)
    owner = np.repeat(np.arange(len(raw), dtype=np.int64), sizes)
    hist = np.bincount(owner * 256 + flat, minlength=256 * len(raw)).reshape(len(raw), 256)
    n = np.maximum(sizes, 1)
    rate = lambda chars: hist[:, list(chars)].sum(1) / n
    words, distinct, repeated = np.ones(len(raw)), np.ones(len(raw)), np.zeros(len(raw))
    for i, t in enumerate(texts):
        w = t.split()
        words[i], distinct[i] = max(1, len(w)), max(1, len(set(w)))
        lines = [x for x in t.split("\n") if x]
        if len(lines) > 1:
            repeated[i] = 1 - len(set(lines)) / len(lines)
    return np.column_stack([
        np.minimum(1, 5 * rate(b"#$%&*@^~=<>{}[]\\")),
        np.minimum(1, 2 * rate(range(65, 91))),
        np.minimum(1, 10 * rate(b"|")),
        np.minimum(1, 10 * rate(b"!")),
        np.minimum(2, words**0.8 / distinct),  # few distinct words for the length: natural text has about n ** 0.8
        repeated,
        np.minimum(1, 4 / words),
        np.minimum(1, 5 * rate(range(48, 58))),
    ])


def with_logit(docs: DataFrame, text_col: str, w: np.ndarray, base: float, name: str, drop: tuple[str, ...] = ()) -> DataFrame:
    """docs (without drop) and the logit under a name; base where there is no text."""
    kept = [f for f in docs.schema.fields if f.name not in drop]
    ids = np.flatnonzero(w[SURFACE:-1])
    own, weights = np.append(w[:SURFACE], w[-1]), w[SURFACE:-1][ids]

    def run(tables):
        words = Weights(ids, weights)
        for table in tables:
            out = np.full(table.num_rows, base)
            for start, texts in batches(table, text_col):
                have = [i for i, t in enumerate(texts) if t]
                if have:
                    out[[start + i for i in have]] = np.clip(logits([texts[i] for i in have], own, words), -30, 30)
            yield pa.RecordBatch.from_arrays([*[table.column(f.name) for f in kept], pa.array(out)], names=[*[f.name for f in kept], name])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(name, T.DoubleType())]))


def labelled(labels: DataFrame, id_col: str, label_col: str, toxic_col: str | None) -> DataFrame:
    """(__gw_lid, __gw_y): 1 for documents of good quality that aren't toxic, 0 for others; the mean of several labels."""
    y = F.col(label_col).cast("double")
    if toxic_col in labels.columns:
        y = F.when(F.col(toxic_col).cast("double") > 0, 0.0).otherwise(y)
    return labels.select(F.col(id_col).alias("__gw_lid"), y.alias("__gw_y")).where("__gw_lid is not null and __gw_y is not null").groupBy("__gw_lid").agg(F.avg("__gw_y").alias("__gw_y"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, max_labelled: int, toxic_col: str | None = "toxic") -> tuple[np.ndarray, float]:
    """Weights (the last is the intercept) and the mean label, by Newton steps on at most max_labelled documents."""
    known = labelled(labels, id_col, label_col, toxic_col).withColumnRenamed("__gw_lid", "__gw_id")
    sample = known.orderBy(F.xxhash64("__gw_id"), "__gw_id").limit(max_labelled)
    joined = docs.select(F.col(id_col).alias("__gw_id"), F.col(text_col).alias("__gw_t")).join(F.broadcast(sample), "__gw_id").where(F.length("__gw_t") > 0)
    # one row of an id, chosen by content: repeated documents don't pile up
    joined = joined.groupBy("__gw_id").agg(F.min_by(F.struct("__gw_t", "__gw_y"), F.xxhash64("__gw_t")).alias("x")).select("x.*")

    def run(tables):
        for table in tables:
            for start, texts in batches(table, "__gw_t"):
                yield pa.RecordBatch.from_arrays([table.column("__gw_y").slice(start, len(texts)), pa.array(list(surface(texts)), pa.list_(pa.float64())), pa.array([buckets(t) for t in texts], pa.list_(pa.int32()))], names=["y", "x", "b"])

    rows = joined.mapInArrow(run, "y double, x array<double>, b array<int>").toPandas()
    w = np.zeros(FEATURES + 1)
    if not len(rows):
        return w, 0.5
    y = rows["y"].to_numpy(float)
    x = np.column_stack([np.vstack(rows["x"].to_numpy()), np.ones(len(y))])
    order = np.lexsort([np.array([sum(b) for b in rows["b"]]), *x.T, y])
    x, y, held = x[order], y[order], [rows["b"].iloc[i] for i in order]
    mean = (y.sum() + 1) / (len(y) + 2)
    start = math.log(mean / (1 - mean))
    w[-1] = start
    if 0 < y.mean() < 1:
        ids, at = np.unique(np.concatenate([np.asarray(b, np.int64) for b in held]), return_inverse=True)
        found = newton(x, at, np.repeat(np.arange(len(y)), [len(b) for b in held]), len(ids), y, start)
        w[SURFACE + ids] = found[: len(ids)]
        w[:SURFACE], w[-1] = found[len(ids) : -1], found[-1]
    return w, float(mean)


def certainty(good: np.ndarray, bad: np.ndarray, n_good: float, n_bad: float) -> np.ndarray:
    """G of each word against the label, from the good and bad documents that hold it."""
    part = lambda a, e: np.where(a > 0, a * np.log(np.maximum(a, 1e-9) / np.maximum(e, 1e-9)), 0)
    n, held = n_good + n_bad, good + bad
    return 2 * (part(good, held * n_good / n) + part(bad, held * n_bad / n) + part(n_good - good, (n - held) * n_good / n) + part(n_bad - bad, (n - held) * n_bad / n))


def newton(x: np.ndarray, at: np.ndarray, owner: np.ndarray, k: int, y: np.ndarray, start: float) -> np.ndarray:
    """Weights of k words, then of the columns of x (the last is the intercept): ridge logistic regression by Newton
    steps, each solved by conjugate gradients. at, owner: word and row of each entry of the sparse part."""
    rows = len(y)
    g = certainty(np.bincount(at, y[owner], k), np.bincount(at, 1 - y[owner], k), y.sum(), rows - y.sum())
    ridge = np.concatenate([WORD_RIDGE / np.maximum(g, 0.1), np.full(x.shape[1], 0.05)])
    ridge[-1] = 1e-6
    to = lambda v: np.bincount(owner, v[:k][at], rows) + x @ v[k:]
    back = lambda r: np.concatenate([np.bincount(at, r[owner], k), x.T @ r])
    cost = lambda v, z: np.logaddexp(0, z).sum() - y @ z + 0.5 * (ridge * v) @ v
    w = np.zeros(k + x.shape[1])
    w[-1] = start
    z = to(w)
    now = cost(w, z)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        slope, h = back(p - y) + ridge * w, p * (1 - p)
        scale = ridge + np.concatenate([np.bincount(at, h[owner], k), (x * x).T @ h])
        step, r = np.zeros_like(w), -slope
        q = r / scale
        d, rq = q, r @ q
        least = 1e-4 * rq
        for _ in range(100):
            if rq <= least:
                break
            hd = back(h * to(d)) + ridge * d
            a = rq / (d @ hd)
            step, r = step + a * d, r - a * hd
            q = r / scale
            new = r @ q
            d, rq = q + new / rq * d, new
        dz, size = to(step), 1.0
        while size > 1e-6 and cost(w + size * step, z + size * dz) > now + 1e-4 * size * (slope @ step):
            size /= 2
        w, z = w + size * step, z + size * dz
        before, now = now, cost(w, z)
        if before - now <= 1e-9 * abs(before):
            break
    return w


def strengths(sites: DataFrame, level: list[str], floor: float = 2.0, most: float = 1e6) -> tuple[float, float]:
    """(mean, prior strength) of site means by moments: the variance between sites beyond what sampling explains."""
    g = sites.groupBy(*level).agg(F.sum("n").alias("n"), F.sum("s").alias("s")).where("n > 0")
    r = g.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("ss"), F.sum(F.col("n") * F.col("n")).alias("nn")).first()
    if not r["k"] or not r["n"]:
        return 0.5, floor
    m = min(max(r["s"] / r["n"], 1e-4), 1 - 1e-4)
    k, n = r["k"], r["n"]
    spread = r["ss"] - n * m * m
    free = n - r["nn"] / n
    between = (spread - (k - 1) * m * (1 - m)) / free if k > 1 and free > 0 else 0.0
    return m, float(min(most, max(floor, m * (1 - m) / between - 1))) if between > 0 else most


def _sites(host: Column | None, path: Column | None) -> tuple[Column, Column]:
    """Host and path of a document: by default the source up to its first '/', and its rest with the language."""
    host = F.element_at(F.split("source", "/"), 1) if host is None else host
    path = F.concat_ws("/", F.regexp_replace("source", "^[^/]*/?", ""), "lang") if path is None else path
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def evidence(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, host: Column | None, path: Column | None, label_col: str, toxic_col: str | None, max_labelled: int):
    """(weights, base logit, cut narrow table (i, h, p, logit) of all documents, prior): prior adds site and posterior to
    a frame that has a logit, a host and a path."""
    session(docs)
    w, mean = fit(docs, labels, id_col, text_col, label_col, max_labelled, toxic_col)
    base = math.log(mean / (1 - mean))
    h, p = _sites(host, path)
    said = cut(with_logit(docs.select(F.col(id_col).alias("i"), h.alias("h"), p.alias("p"), F.col(text_col).alias("t")), "t", w, base, "logit", ("t",)))
    sites = cut(said.groupBy("h", "p").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum(1 / (1 + F.exp(-F.col("logit")))).alias("s")))
    m, s_host = strengths(sites, ["h"])
    _, s_path = strengths(sites, ["h", "p"])
    hosts = sites.groupBy(F.col("h").alias("hh")).agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    table = stored(sites.join(hosts, F.col("h") == F.col("hh")).select("h", "p", "n", "s", "hn", "hs"))

    def prior(frame: DataFrame, logit: str, at: str, under: str, site: str, post: str) -> DataFrame:
        names = {c: fresh(frame, f"__gw_{c}") for c in table.columns}
        out = frame.join(table.select(*[F.col(c).alias(x) for c, x in names.items()]), (F.col(at) == F.col(names["h"])) & (F.col(under) == F.col(names["p"])), "left")
        n, s, hn, hs = (F.col(names[c]) for c in ("n", "s", "hn", "hs"))
        own = 1 / (1 + F.exp(-F.col(logit)))
        at_host = (F.greatest(F.lit(0.0), hs - own) + s_host * m) / (F.greatest(F.lit(0.0), hn - 1) + s_host)
        at_path = (F.greatest(F.lit(0.0), s - own) + s_path * at_host) / (F.greatest(F.lit(0.0), n - 1) + s_path)
        inside = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), at_path))
        total = F.col(logit) + F.log(inside / (1 - inside)) - math.log(m / (1 - m))
        return out.withColumns({site: inside, post: 1 / (1 + F.exp(-total))}).drop(*names.values())

    return w, base, said, prior


def posteriors(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, label_col: str = "quality", toxic_col: str | None = "toxic", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """id, classifier_p, site_p, posterior, keep for every document; all but the classifier works on the narrow table."""
    _, _, said, prior = evidence(docs, labels, id_col, text_col, host, path, label_col, toxic_col, max_labelled)
    s = prior(said, "logit", "h", "p", "site", "post")
    return s.select(F.col("i").alias(id_col), F.round(1 / (1 + F.exp(-F.col("logit"))), 6).alias("classifier_p"), F.round("site", 6).alias("site_p"), F.round("post", 6).alias("posterior"), (F.col("post") >= threshold).alias("keep"))


def keep(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None, label_col: str = "quality", toxic_col: str | None = "toxic", max_labelled: int = MAX_LABELLED) -> DataFrame:
    """docs, its columns as they are, without the documents that the classifier rejects."""
    w, base, _, prior = evidence(docs, labels, id_col, text_col, host, path, label_col, toxic_col, max_labelled)
    logit, at, under, site, post = (fresh(docs, f"__gw_{x}") for x in ("logit", "at", "under", "site", "post"))
    h, p = _sites(host, path)
    rated = with_logit(docs.withColumns({at: h, under: p}), text_col, w, base, logit)
    return prior(rated, logit, at, under, site, post).where(F.col(post) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posteriors(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
