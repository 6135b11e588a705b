"""Facts as an edge table (relation, subject, object): closure, expansion, neighbours, proofs, components."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut

#: Relations that chain.
TRANSITIVE = ("is_a", "related_to")
#: Relations that a proof may use, in the order tried.
PROVEN = ("is_a", "used_for", "related_to")


def with_facts(facts: DataFrame, more: DataFrame) -> DataFrame:
    """Both, each fact once."""
    return facts.unionByName(more).dropDuplicates(["relation", "subject", "object"])


def closure(facts: DataFrame) -> DataFrame:
    """All (relation, subject, object) that can be proven: facts, and chains of the transitive relations.

    Path doubling: each round joins what is known with itself and is cut, so rounds grow with the logarithm of the
    longest chain; cycles end when nothing new appears."""
    known = cut(facts.select("relation", "subject", "object").distinct())
    size = known.count()
    while True:
        far = known.where(F.col("relation").isin(*TRANSITIVE))
        step = far.alias("a").join(far.alias("b"), (F.col("a.relation") == F.col("b.relation")) & (F.col("a.object") == F.col("b.subject"))).select("a.relation", "a.subject", "b.object")
        known = cut(known.union(step).distinct())
        now = known.count()
        if now == size:
            return known
        size = now


def provable(facts: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (relation, subject, object) with a column holds."""
    return asked.join(closure(facts).withColumn("__yes", F.lit(True)), ["relation", "subject", "object"], "left").select("relation", "subject", "object", F.coalesce("__yes", F.lit(False)).alias("holds"))


def undirected(facts: DataFrame) -> DataFrame:
    """(token, neighbor) over all relations, either way, each once."""
    return facts.select(F.explode(F.array(F.struct(F.col("subject").alias("token"), F.col("object").alias("neighbor")), F.struct(F.col("object").alias("token"), F.col("subject").alias("neighbor")))).alias("x")).select("x.*").where("token <> neighbor").distinct()


def expand(facts: DataFrame, seeds: DataFrame, depth: int = 2, most: int = 50, decay: float = 0.7, least: float = 0.3) -> DataFrame:
    """(query_id, token, confidence): breadth first from the seeds (query_id, token), seeds left out; the shortest way
    counts; per query the most confident, ties by name."""
    near = undirected(facts)
    seen = cut(seeds.select("query_id", "token").distinct().withColumn("hops", F.lit(0)))
    front = seen
    for hop in range(1, depth + 1):
        if decay**hop < least:
            break
        new = front.join(near, "token").select("query_id", F.col("neighbor").alias("token")).distinct().join(seen, ["query_id", "token"], "left_anti")
        front = cut(new.withColumn("hops", F.lit(hop)))
        seen = seen.union(front)
    w = Window.partitionBy("query_id").orderBy("hops", "token")
    return seen.where("hops > 0").withColumn("r", F.row_number().over(w)).where(F.col("r") <= most).select("query_id", "token", F.round(F.pow(F.lit(decay), F.col("hops")), 6).alias("confidence"))


def paths(facts: DataFrame) -> DataFrame:
    """(relation, subject, object, path): the shortest chain of each provable fact of the relations in PROVEN, by names
    where several are as short; path: the nodes from the subject to the object.

    One join a hop: only the best chain of each pair goes on, and what is known already isn't found again."""
    step = cut(facts.where(F.col("relation").isin(*PROVEN)).select("relation", "subject", "object").distinct())
    front = cut(step.withColumn("path", F.array("subject", "object")))
    known = front
    while not front.isEmpty():
        near = step.select("relation", F.col("subject").alias("object"), F.col("object").alias("next"))
        new = front.join(near, ["relation", "object"]).select("relation", "subject", F.col("next").alias("object"), F.concat("path", F.array("next")).alias("path"))
        new = new.groupBy("relation", "subject", "object").agg(F.min("path").alias("path"))
        front = cut(new.join(known, ["relation", "subject", "object"], "left_anti"))
        known = cut(known.union(front))
    return known


def proofs(facts: DataFrame) -> DataFrame:
    """(subject, object, depth, relation, source, target): the steps that lead from one name to another by the first
    relation of PROVEN that does."""
    order = F.array_position(F.array(*map(F.lit, PROVEN)), F.col("relation"))
    best = paths(facts).groupBy("subject", "object").agg(F.min(F.struct(order.alias("o"), "relation", "path")).alias("x"))
    hops = F.transform(F.sequence(F.lit(0), F.size("x.path") - 2), lambda k: F.struct(k.alias("depth"), F.get("x.path", k).alias("source"), F.get("x.path", k + 1).alias("target")))
    return best.select("subject", "object", F.col("x.relation").alias("relation"), F.explode(hops).alias("h")).select("subject", "object", "h.depth", "relation", "h.source", "h.target")


class Proofs:
    """Explanations over a bounded set of facts, held by the driver in the order they were added."""

    def __init__(self, facts: Iterable[tuple[str, str, str]]):
        self.out: dict[str, dict[str, list[str]]] = {}
        for relation, subject, object_ in facts:
            listed = self.out.setdefault(relation, {}).setdefault(subject, [])
            if object_ not in listed:
                listed.append(object_)

    def path(self, subject: str, object_: str) -> list[dict]:
        """Steps of a proof: relations in their order, depth first, direct edges first at every node. Empty without one."""
        for relation in PROVEN:
            if steps := self._walk(relation, subject, object_, {subject}):
                return [{"relation": relation, "source": a, "target": b, "depth": n, "rule": f"{relation}({a}, {b})"} for n, (a, b) in enumerate(steps)]
        return []

    def _walk(self, relation: str, at: str, goal: str, seen: set[str]) -> list[tuple[str, str]]:
        stack = [(at, [])]
        while stack:
            node, steps = stack.pop()
            ahead = self.out.get(relation, {}).get(node, [])
            if goal in ahead:
                return [*steps, (node, goal)]
            fresh = [x for x in ahead if x not in seen]
            seen.update(fresh)
            stack.extend((x, [*steps, (node, x)]) for x in reversed(fresh))
        return []

    def explain(self, relation: str, subject: str, object_: str) -> str:
        steps = self._walk(relation, subject, object_, {subject}) if relation in self.out else []
        if not steps or (len(steps) > 1 and relation not in TRANSITIVE):
            return f"Cannot prove {relation}({subject}, {object_})"
        return "\n".join(f"{relation}({a}, {b})" for a, b in steps)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(token, root): the smallest member of each connected component. Labels are halved along their own links each
    round, so long chains take few; cut after each."""
    two = edges.select(F.col(a).alias("u"), F.col(b).alias("v"))
    both = cut(two.union(two.select("v", "u")).where("u <> v").distinct())
    labels = cut(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")))
    while True:
        around = both.join(labels.select(F.col("u").alias("v"), F.col("root").alias("r")), "v").groupBy("u").agg(F.min("r").alias("r"))
        step = labels.join(around, "u").select("u", F.least("root", "r").alias("root"))
        jump = step.select(F.col("u").alias("root"), F.col("root").alias("further"))
        new = cut(step.join(jump, "root").select("u", F.least("root", "further").alias("root")))
        if new.join(labels.withColumnRenamed("root", "old"), "u").where("root <> old").isEmpty():
            return new.select(F.col("u").alias("token"), "root")
        labels = new


def clusters(edges: DataFrame, least: int = 3) -> DataFrame:
    """(root, tokens, size) of the components of at least that many tokens."""
    return grouped(components(edges), least)


def grouped(members: DataFrame, least: int = 3) -> DataFrame:
    """(root, tokens, size) of components() of at least that many tokens, by their first name."""
    out = members.groupBy("root").agg(F.array_sort(F.collect_list("token")).alias("tokens"), F.count(F.lit(1)).alias("size")).where(F.col("size") >= least)
    return out.select(F.element_at("tokens", 1).alias("root"), "tokens", "size")


def synonym_groups(linked: DataFrame, limit: int | None = None) -> DataFrame:
    """(canonical, variants, score, support): components of (a, b, score, n); the first by name is canonical; each edge
    counts at both of its ends for the support. By score, ties by name."""
    roots = components(linked)
    ends = linked.select(F.explode(F.array("a", "b")).alias("token"), "score", "n").join(roots, "token").groupBy("root").agg(F.max("score").alias("score"), F.sum("n").alias("support"))
    members = roots.where("token <> root").groupBy("root").agg(F.array_sort(F.collect_list("token")).alias("variants"))
    out = members.join(ends, "root").select(F.col("root").alias("canonical"), "variants", "score", "support")
    return out if limit is None else out.orderBy(F.desc(F.round("score", 6)), "canonical").limit(limit)
