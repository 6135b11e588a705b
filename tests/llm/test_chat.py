import random
from itertools import groupby

from glosswork.llm import chat

TURNS = "conv_id long, turn long, role string, text string"


def brute(data):
    by = {}
    for c, n, r, t in data:
        if c is not None:
            by.setdefault(c, set()).add((n is not None, n or 0, r if r is not None else "unknown", t or ""))
    out = []
    for c, ts in by.items():
        runs = [(r, "\n".join(x[3] for x in g)) for r, g in groupby(sorted(ts), key=lambda x: x[2])]
        out.append((c, len(ts), len(runs), " ".join(r for r, _ in runs), "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in runs)))
    return sorted(out)


def test_equals_brute_force(spark):
    rng = random.Random(4)
    data = [(rng.randint(0, 20), rng.randint(0, 9), rng.choice(["user", "assistant", "system"]), rng.choice(["", "a", "b\nc", "é"])) for _ in range(400)]
    data += [(None, 1, "user", "x"), (30, None, "user", "first"), (30, 0, None, None), (30, 0, None, None), (31, 5, "user", "w" * 100_000)]
    assert sorted(map(tuple, chat.formatted(spark.createDataFrame(data, TURNS)).collect())) == brute(data)


def test_a_very_long_conversation(spark):
    data = [(1, n, "user" if n % 3 else "assistant", f"t{n}") for n in range(3000)]
    assert sorted(map(tuple, chat.formatted(spark.createDataFrame(data, TURNS)).collect())) == brute(data)


def test_repeated_turns_of_many_partitions_count_once(spark):
    data = [(n % 7, n % 50, "user" if n % 2 else None, f"t{n % 50}") for n in range(7000)] + [(3, None, None, None)] * 500
    assert sorted(map(tuple, chat.formatted(spark.createDataFrame(data, TURNS).repartition(16)).collect())) == brute(data)


def test_long_conversations_take_time_in_proportion(spark):
    import time

    took = {}
    for n in (20_000, 20_000, 40_000):  # the first run warms up
        df = spark.range(n).selectExpr("1L as conv_id", "id as turn", "if(id % 3 = 0, 'assistant', 'user') as role", "concat('t', id) as text")
        began = time.perf_counter()
        assert chat.formatted(df).first()["n_turns"] == n
        took[n] = time.perf_counter() - began
    assert took[40_000] < 3.2 * took[20_000] + 1


def test_only_spark_expressions(spark):
    plan = chat.formatted(spark.createDataFrame([(1, 1, "user", "a")], TURNS))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_empty_and_extra_columns(spark):
    assert chat.formatted(spark.createDataFrame([], TURNS)).count() == 0
    data = [(1, 1, "user", "a", 5, "z")]
    assert chat.formatted(spark.createDataFrame(data, TURNS + ", ts int, at string")).first()["chat"] == "<|user|>\na<|end|>\n"
