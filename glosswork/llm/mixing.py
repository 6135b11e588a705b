"""Mixing sources to target weights: soft membership and projected-gradient least squares.

1. A softmax classifier over hashed byte pairs is fitted on a bounded sample of the documents that the label table
   covers; its classes are the domains (production: the language). Every document gets a posterior over the domains,
   in steps of 1 / STEPS.
2. Nonnegative document rates r minimise sum_d ((sum_i r_i t_i p_id - T_d) / T)^2, where t_i are the document's
   tokens, p_id its posteriors and T_d the target tokens of a domain. Rates start at 1. The sure step is the projected
   gradient under a fixed diagonal scaling, r_i <- max(0, r_i - (sum_d p_id g_d) / (sum_d p_id c_d)), where g is what a
   domain has too much and c what it has at rate 1: the scaling is the row sums of the Hessian, which has no negative
   entry, so it bounds the curvature and the objective falls, whatever the posteriors. Each round measures this step
   beside bolder ones (multiples of it, momentum, and steps scaled by the D x D curvature of the documents that are free
   to move) and takes the one of the least objective; so it never rises, and rates stay finite.
3. It ends where the sure step would move at most TOLERANCE / 100 of the target tokens, which is the optimality
   condition, met also where the targets can't be reached, or where all targets are met within TOLERANCE. Rates that
   haven't got there after ROUNDS are reported by a warning.
4. Documents of equal posteriors get equal rates, so the rounds run over the distinct posteriors with summed tokens. A
   rate is a function of the posterior and of the D-vectors of the rounds: executors replay them, the driver holds D
   numbers a round.

The target total is by default the least that needs no rate below 1 where domains are disjoint (epochs are added to what
is short, 1 % more than that for soft memberships; nothing is thrown away). Domains that have no target, or one of 0 or
less, are left alone: they don't count in the objective, so their documents keep about rate 1. apply() turns rates into
copies: floor(r) and one more with probability r - floor(r), decided by a hash.

Defined cases. Null or empty text: 0 tokens, the prior as posterior, rate by the same formula. Targets that no label
shows are left out and the rest scaled to 1. No usable domain or an empty table: rates of 1. Null labels are ignored; a
document labelled twice counts once, and of several rows of a labelled id one is learnt from. Repeated rows each get the
same rate, and the same number of copies. Extra columns of any name pass through apply().
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, cut, fresh, read, session

MAX_LABELLED = 4000
DIM = 1024
ROUNDS = 200
TOLERANCE = 1e-4
#: Steps of a posterior.
STEPS = 1000
#: Shares of the token total by domain in production.
TARGETS = {"en": 0.52, "de": 0.18, "fr": 0.18, "es": 0.12}


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(root frequencies of hashed byte pairs, white-space tokens) of whole texts."""
    raw = [(t or "").lower().encode() for t in texts]
    sizes = np.array([len(r) for r in raw], np.int64)
    x = np.zeros((len(raw), DIM))
    flat = np.frombuffer(b"".join(raw), np.uint8).astype(np.int64)
    if len(flat) > 1:
        key = (flat[:-1] * 37 + flat[1:] * 5 + (flat[:-1] >> 4)) % DIM
        owner = np.repeat(np.arange(len(raw), dtype=np.int64), sizes)
        inside = owner[:-1] == owner[1:]
        x = np.bincount((owner[:-1] * DIM + key)[inside], minlength=DIM * len(raw)).reshape(len(raw), DIM).astype(float)
    total = np.maximum(x.sum(1, keepdims=True), 1)
    return np.sqrt(x / total), np.array([len(t.split()) if t else 0 for t in texts], np.int64)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, domain_col: str, max_labelled: int) -> tuple[list[str], np.ndarray]:
    """(domains, weights (D, DIM + 1)) from at most max_labelled labelled documents, by accelerated gradient steps."""
    known = labels.select(F.col(id_col).alias("__gw_id")).where("__gw_id is not null").distinct()
    sample = known.orderBy(F.xxhash64("__gw_id"), "__gw_id").limit(max_labelled)
    joined = docs.select(F.col(id_col).alias("__gw_id"), F.col(text_col).alias("__gw_t"), F.col(domain_col).cast("string").alias("__gw_d")).where("length(__gw_t) > 0 and __gw_d is not null").join(F.broadcast(sample), "__gw_id")

    def run(tables):
        for table in tables:
            for start, texts in batches(table, "__gw_t"):
                x, _ = features(texts)
                yield pa.RecordBatch.from_arrays([table.column("__gw_d").slice(start, len(texts)), pa.array(list(x.astype(np.float32)), pa.list_(pa.float32()))], names=["d", "x"])

    # one row of an id, chosen by content: repeated documents don't pile up
    one = joined.groupBy("__gw_id").agg(F.min_by(F.struct("__gw_t", "__gw_d"), F.xxhash64("__gw_t", "__gw_d")).alias("x")).select("x.*")
    rows = one.mapInArrow(run, "d string, x array<float>").toPandas()
    if not len(rows):
        return [], np.zeros((0, DIM + 1))
    names = sorted(rows["d"].unique())
    y = np.searchsorted(names, rows["d"].to_numpy(dtype=object).astype(str))
    x = np.column_stack([np.vstack(rows["x"].to_numpy()).astype(float), np.ones(len(y))])
    order = np.lexsort([x[:, k] for k in range(8)] + [y])
    x, y = x[order], y[order]
    one = np.eye(len(names))[y]
    w = v = np.zeros((len(names), x.shape[1]))
    for k in range(150):
        g = (softmax(x @ v.T) - one).T @ x / len(y) + 1e-4 * v
        new = v - 1.0 * g
        v = new + k / (k + 3) * (new - w)
        w = new
    return names, w


def members(docs: DataFrame, names: list[str], w: np.ndarray, text_col: str, added: tuple[str, str, str], drop: tuple[str, ...] = (), path: Path | None = None) -> DataFrame:
    """docs (without drop) with tokens, posterior and (with a path) rate under the added names, in one pass over the texts."""
    kept = [f for f in docs.schema.fields if f.name not in drop]
    fields = [T.StructField(added[0], T.LongType()), T.StructField(added[1], T.ArrayType(T.DoubleType()))] + [T.StructField(added[2], T.DoubleType())] * (path is not None)

    def run(tables):
        for table in tables:
            tokens, post = [], []
            for _, texts in batches(table, text_col):
                x, t = features(texts)
                tokens.append(t)
                post.append(stepped(softmax(x @ w[:, :-1].T + w[:, -1])) if names else np.zeros((len(texts), 0)))
            post = np.concatenate(post) if post else np.zeros((0, len(names)))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(post) + 1) * len(names), pa.int32()), pa.array(post.ravel()))
            rate = [] if path is None else [pa.array(path.replay(post)[0])]
            yield pa.RecordBatch.from_arrays([*[table.column(f.name) for f in kept], pa.array(np.concatenate(tokens) if tokens else np.zeros(0, np.int64)), lists, *rate], names=[f.name for f in [*kept, *fields]])

    return docs.mapInArrow(run, T.StructType([*kept, *fields]))


def stepped(post: np.ndarray) -> np.ndarray:
    """Posteriors in whole steps that still add up to 1: the largest remainders are rounded up."""
    x = post * STEPS
    low = np.floor(x)
    missing = np.rint(STEPS - low.sum(1)).astype(int)
    rank = np.argsort(np.argsort(low - x, axis=1, kind="stable"), axis=1, kind="stable")
    return (low + (rank < missing[:, None])) / STEPS


@dataclass
class Path:
    """The steps taken, D numbers each: enough to find the rate of any posterior."""

    scale: np.ndarray
    goal: np.ndarray
    #: (kind, D-vector, factor): see stepped_by().
    steps: list[tuple[str, np.ndarray, float]] = field(default_factory=list)
    #: Expected tokens by domain at the end, and whether the optimality condition is met.
    got: np.ndarray | None = None
    converged: bool = True

    def weight(self, post: np.ndarray) -> np.ndarray:
        w = post @ self.scale
        return np.where(w > 0, w, np.inf)

    def stepped_by(self, post: np.ndarray, w: np.ndarray, r: np.ndarray, before: np.ndarray, step: tuple[str, np.ndarray, float]) -> np.ndarray:
        """The rates after one more step: by the scaled gradient, by a curvature's direction, or by momentum beyond the
        sure step."""
        kind, u, factor = step
        if kind == "curved":
            return np.maximum(0.0, r - factor * (post @ u))
        if kind == "scaled":
            return np.maximum(0.0, r - factor * (post @ u) / w)
        sure = np.maximum(0.0, r - (post @ u) / w)
        return np.maximum(0.0, sure + factor * (sure - before))

    def replay(self, post: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rates, rates before the last step)."""
        r = before = np.ones(len(post))
        w = self.weight(post)
        for step in self.steps:
            before, r = r, self.stepped_by(post, w, r, before, step)
        return r, before


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, width)


def solve(cells: DataFrame, names: list[str], targets: dict[str, float], total: float | None, rounds: int, tolerance: float) -> Path:
    """The rounds over a cut table of (tokens, post)."""
    weight = np.array([max(0.0, targets.get(n, 0.0)) for n in names])
    width = len(names)

    def summed(size: int, of) -> np.ndarray:
        """The sum over all cells of the size numbers that of(posteriors, tokens) gives for a batch."""

        def run(tables):
            for b in tables:
                v = of(_matrix(b.column("post"), width), np.asarray(b.column("tokens")).astype(float))
                yield pa.RecordBatch.from_arrays([pa.array([v.tolist()], pa.list_(pa.float64()))], names=["s"])

        out = np.zeros(size)
        for k, v in cells.mapInArrow(run, "s array<double>").select(F.posexplode("s")).groupBy("pos").agg(F.sum("col")).collect():
            out[k] = v
        return out

    path = Path(np.zeros(width), np.zeros(width))
    now = summed(width, lambda p, t: t @ p) if width else np.zeros(0)
    path.scale, path.got = now, now
    usable = (weight > 0) & (now > 0)
    if not usable.any():
        return path
    share = np.where(usable, weight, 0) / weight[usable].sum()
    path.goal = share * (total if total else float((now[usable] / share[usable]).max() * 1.01))
    gap = lambda s: np.where(usable, s - path.goal, 0)
    most = tolerance * path.goal.sum()

    def around(p: np.ndarray, t: np.ndarray) -> np.ndarray:
        """Tokens that the sure step moves, and the curvature of the documents that are above 0 or will be, and that will be."""
        r, _ = path.replay(p)
        sure = np.maximum(0.0, r - (p @ g) / path.weight(p))
        free = [(p * (t * a)[:, None]).T @ p for a in ((r > 0) | (sure > 0), sure > 0)]
        return np.concatenate([[t @ np.abs(sure - r)], *(x.ravel() for x in free)])

    def tried(p: np.ndarray, t: np.ndarray) -> np.ndarray:
        r, before = path.replay(p)
        w = path.weight(p)
        return np.concatenate([(t * path.stepped_by(p, w, r, before, x)) @ p for x in steps])

    for _ in range(rounds):
        g = gap(now)
        if np.abs(g).max() <= most / width:
            break
        found = summed(1 + 2 * width * width, around)
        if found[0] <= most / 100:
            break
        steps = [("scaled", g, f) for f in (1.0, 3.0, 10.0, 40.0)] + [("momentum", g, f) for f in (2.0, 8.0)]
        for c in found[1:].reshape(2, width, width):
            u = np.linalg.lstsq(c + 1e-9 * max(1.0, np.trace(c)) * np.eye(width), g, rcond=None)[0]
            steps += [("curved", u, f) for f in (1.0, 0.3, 0.1)]
        sums = summed(width * len(steps), tried).reshape(len(steps), width)
        best = int(np.argmin([np.square(gap(s)).sum() for s in sums]))
        path.steps.append(steps[best])
        now = path.got = sums[best]
    else:
        path.converged = False
        warnings.warn(f"rates aren't settled after {rounds} rounds: {now.round().tolist()} tokens for {path.goal.round().tolist()}", stacklevel=2)
    return path


def rated(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, total: float | None = None, id_col: str = "doc_id", text_col: str = "text", domain_col: str = "lang", max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS, tolerance: float = TOLERANCE, drop: tuple[str, ...] = ()) -> tuple[DataFrame, list[str], tuple[str, str, str]]:
    """(docs with tokens, posterior and rate, the domains, the names of the three columns)."""
    session(docs)
    names, w = fit(docs, labels, id_col, text_col, domain_col, max_labelled)
    said = members(docs.select(F.col(text_col).alias("t")), names, w, "t", ("tokens", "post", ""), ("t",))
    cells = cut(said.groupBy("post").agg(F.sum("tokens").alias("tokens")))
    path = solve(cells, names, TARGETS if targets is None else targets, total, rounds, tolerance)
    added = tuple(fresh(docs, x) for x in ("__gw_tokens", "__gw_post", "__gw_rate"))
    return members(docs, names, w, text_col, added, drop, path), names, added


def rates(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """id, tokens, posterior (by domain name), rate of every document."""
    id_col, text_col, domain = kw.get("id_col", "doc_id"), kw.get("text_col", "text"), kw.get("domain_col", "lang")
    out, names, (tokens, posterior, rate) = rated(docs.select(*dict.fromkeys([id_col, text_col, domain])), labels, drop=(text_col,), **kw)
    post = F.map_from_arrays(F.array(*map(F.lit, names)).cast("array<string>"), posterior)
    return out.select(id_col, F.col(tokens).alias("tokens"), post.alias("posterior"), F.round(rate, 6).alias("rate"))


def apply(docs: DataFrame, labels: DataFrame, **kw) -> DataFrame:
    """docs, its columns as they are, each row as often as its rate says."""
    id_col, text_col = kw.get("id_col", "doc_id"), kw.get("text_col", "text")
    out, _, (_, _, name) = rated(docs, labels, **kw)
    chance = F.pmod(F.xxhash64(F.lit("mix"), F.col(f"`{id_col}`"), F.col(f"`{text_col}`")), F.lit(1 << 30)) / float(1 << 30)
    # rates are rounded: replays on other batches may differ in the last bits
    rate = F.round(name, 6)
    copies = F.floor(rate) + F.when(chance < rate - F.floor(rate), 1).otherwise(0)
    return out.withColumn(fresh(out, "__gw_k"), F.explode(F.when(copies > 0, F.sequence(F.lit(1), copies.cast("int"))))).select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
