import random
import re

from glosswork.llm import decontam

from .frames import DOCS, clashing, frame, odd, prose, rows, same_rows

ITEMS = "item_id long, text string"


def distance(p, t):
    """Least edit distance of p to a substring of t."""
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def brute(docs, items):
    out = []
    for i, t, *_ in docs:
        for k, p in items:
            if t and p:
                a, b = decontam.normal(p), decontam.normal(t)
                if len(a) >= decontam.MIN_CHARS:
                    if (d := distance(a, b)) <= int(decontam.RATE * len(a)):
                        out.append((repr(i), repr(k), d))
                elif len(a) >= decontam.SHORT_SEED and len(a.split()) >= decontam.SHORT_WORDS and re.search(r"(?<![^\W_])" + re.escape(a) + r"(?![^\W_])", b):
                    out.append((repr(i), repr(k), 0))
    return sorted(out)


def data():
    rng = random.Random(8)
    items_twin = prose(random.Random(80), "en", 14)
    items = [(k, prose(rng, "en", 14)) for k in range(12)] + [(80, items_twin)] + [(90, None), (91, "short"), (92, ""), (93, "a short one"), (94, "What is  THIS?"), (95, items_twin), (None, prose(rng, "fr", 14))]
    docs = rows(30, 9, 10, 30)
    for k in range(30):
        p = rng.choice(items[:12])[1]
        q = list(p)
        for _ in range(rng.randint(0, 5)):
            at = rng.randrange(len(q))
            q[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "yy"])
        docs.append((200 + k, prose(rng, "de", 6) + " " + "".join(q).upper() + "\n" + prose(rng, "de", 6), "en", "s", 1))
    docs.append((300, items[-1][1], "fr", "s", 1))
    docs += [(301, "so, a short one.", "en", "s", 1), (302, "a short ones", "en", "s", 1), (303, "xa short one", "en", "s", 1), (304, "w " + items_twin, "en", "s", 1), (305, "and what is this? yes", "en", "s", 1)]
    return docs, items


def test_pairs_equal_brute_force(spark, monkeypatch):
    docs, items = data()
    docs = docs + [r for r in odd() if len(r[1] or "") < 9000]
    got = lambda **kw: sorted((repr(r[0]), repr(r[1]), r[2]) for r in map(tuple, decontam.pairs(frame(spark, docs), spark.createDataFrame(items, ITEMS), **kw).collect()))
    want = brute(docs, items)
    assert len(want) > 5
    assert got() == want
    monkeypatch.setattr(decontam, "STEP", 50)
    assert decontam.STEP == 50 and got() == want


def test_drop_takes_exactly_the_documents_with_a_hit(spark):
    docs, items = data()
    docs = docs + odd()
    hit = {x[0] for x in brute([d for d in docs if len(d[1] or "") < 9000], items)}
    want = [d for d in docs if repr(d[0]) not in hit]
    assert same_rows(decontam.drop(clashing(spark, docs), spark.createDataFrame(items, ITEMS)), want)


def test_many_items_with_one_seed_many_files_and_shards(spark, monkeypatch):
    docs, items = data()
    items = [(1000 + k, "the very same beginning of all items " + t) for k, (_, t) in enumerate(items) if t] + [x for x in items if x[1]]
    docs = [(*d[:1], f"{d[1]} {items[n % 20][1]}", *d[2:]) for n, d in enumerate(docs) if d[1]]
    real = decontam.shelve
    monkeypatch.setattr(decontam, "shelve", lambda df: real(df, 10))
    m = decontam.matcher(spark.createDataFrame(items, ITEMS).repartition(4), "item_id", "text", decontam.RATE, decontam.MIN_CHARS)
    assert m.shelf.bits >= 3
    got = sorted((repr(docs[i][0]), repr(k), d) for i, k, d in m.find([d[1] for d in docs]))
    assert got == brute(docs, items)


def test_empty_tables(spark):
    docs, items = data()
    none = spark.createDataFrame([], ITEMS)
    assert decontam.pairs(frame(spark, docs), none).count() == 0
    assert decontam.drop(frame(spark, docs), none).count() == len(docs)
    assert decontam.pairs(frame(spark, [], DOCS), spark.createDataFrame(items, ITEMS)).count() == 0
