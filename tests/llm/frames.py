"""Small inputs: plain documents, and ones with every oddity that an operator has to take."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, as columns of the documents.
EXTRA = "id long, t string, k int, h long, n long, s string, a string, p double, group_id long, shard string, bad boolean"
LABELS = "doc_id long, quality int, toxic int"
WORDS = {
    "en": "the of and that with for this from have not water house light under story never again little people other words between country school father where".split(),
    "de": "der die und das nicht mit auf für sich auch wasser haus straße über zwischen schule immer wieder menschen andere worte größer während können".split(),
    "fr": "le la les des que dans pour avec sur pas été même où être maison lumière école toujours encore entre histoire petite autres après".split(),
}


def prose(rng: random.Random, lang: str, n: int) -> str:
    out = []
    for i in range(n):
        w = rng.choice(WORDS[lang]) + rng.choice(["", "", "", rng.choice("aeinrst")])
        out.append(w + (".\n" if i % 11 == 10 else ""))
    return " ".join(out)


def junk(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(["###", "$$", "|||", "BUY!!!", "<<>>", "%%", "CLICK!!", "{}[]"]) for _ in range(n))


def rows(n: int, seed: int = 1, lo: int = 60, hi: int = 160):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = sorted(WORDS)[i % 3]
        t = prose(rng, lang, rng.randint(lo, hi))
        out.append((i, t, lang, f"src{i % 4}", len(t)))
    return out


def odd(seed: int = 2):
    rng = random.Random(seed)
    t = prose(rng, "en", 80)
    long = prose(rng, "de", 30_000)
    return [(1000, None, "en", "src0", 0), (1001, "", "en", "src0", 0), (1002, "  \n\t", None, None, 4), (None, t + " null", "fr", "src1", 9), (1003, t, "en", None, 9), (1003, t, "en", None, 9), (1004, long, "de", "src2", None), (1005, "x", None, "src9/deep/er", 1), (None, None, None, None, None), (1006, "\U0001f600 \U0001f600", "en", "src0", 3)]


def frame(spark, data, schema=DOCS):
    return spark.createDataFrame(data, schema)


def clashing(spark, data):
    """The documents with more columns, whose names the operators use themselves."""
    more = (7, "t", 3, 5, 6, "s", "a", 0.5, 8, "shard", True)
    return spark.createDataFrame([(*r, *more) for r in data], f"{DOCS}, {EXTRA}")


def same_rows(df, data, n=5):
    return sorted(map(repr, (tuple(r)[:n] for r in df.collect()))) == sorted(map(repr, (tuple(r)[:n] for r in data)))
