"""Small corpora with every awkward case: NULLs, empty and very long texts, ties,
repeated rows, copies, and columns whose names clash with the operators'."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = (SCHEMA + ", score double, shard int, slot long, epoch long, block long, mix_order long, leak string, "
            "fp long, digest string, __key string, __row_hash string, state string, edits string, kept boolean")


def sentence(rng: random.Random, n: int) -> str:
    parts = ["the", "of", "and", "on", "ing", "er", "th", "an", "re", "ed"]
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def texts(seed: int = 1, n: int = 60) -> list[str | None]:
    rng = random.Random(seed)
    plain = [sentence(rng, rng.randint(1, 80)) for _ in range(n)]
    long = sentence(rng, 12_000)
    near = sentence(rng, 200)
    return [*plain, None, "", " \t\n", "x", "Élan vital où ça", long, long, plain[0], plain[0].replace(" ", "\n "),
            plain[0].upper(), near, near + " end", "start " + near, "\x00nul", "naïve  \x0b blank", "!" * 500]


def rows(seed: int = 1, n: int = 60) -> list[tuple]:
    out = [(i, t, "en", f"src{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts(seed, n))]
    out += [out[3], out[3], (3, "other text of a repeated id", "en", "src1", 5)]
    out += [(None, "no id", None, None, None), (None, "no id", None, None, None), (None, out[0][1], None, "src0", 1)]
    return out


def documents(spark, seed: int = 1, n: int = 60, partitions: int = 3):
    return spark.createDataFrame(rows(seed, n), SCHEMA).repartition(partitions)


def clashing(spark, n: int = 30):
    extra = (0.5, 1, 2, 3, 4, 5, "leak", 6, "digest", "key", "hash", "state", "edits", True)
    return spark.createDataFrame([(*r, *extra) for r in rows(2, n)], CLASHING)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
