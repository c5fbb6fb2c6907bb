import random

import public_tokenizers
import pytest

EDGE = [
    (1, "The quick brown fox jumps over the lazy dog near the old river bank today", "en"),
    (2, "The  quick brown\tfox jumps over the lazy dog near the old river\nbank today", "en"),
    (3, None, "en"),
    (4, "", None),
    (5, "   \n\t ", "de"),
    (6, "1234 5678 !!", "de"),
    (7, "Der schnelle braune Fuchs springt über den faulen Hund am alten Fluss", "de"),
    (7, "Der schnelle braune Fuchs springt über den faulen Hund am alten Fluss", "de"),
    (None, "The quick brown fox jumps over the lazy dog near the old river bank today", "en"),
    (None, None, None),
    (8, "one two", "en"),
    (9, "ONE two", "en"),
    (10, "<|endoftext|> a<s>b ▁   x \U0001f600 世界 é é İ", "en"),
    (11, "word " * 30000 + "end", "en"),
    (12, "\n".join(f"line {k % 7} of the same text again and again" for k in range(40)), "en"),
    (13, "x" * 5000, None),
    (-5, "one two", "en"),
]


@pytest.fixture(scope="session")
def edge_rows():
    return list(EDGE)


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table, with columns whose names the operators use inside."""

    def make(rows):
        more = [(*r, "src", 1, 2, "z", 3, "w", 4) for r in rows]
        return spark.createDataFrame(
            more,
            "doc_id bigint, text string, lang string, source string, n_chars bigint, key bigint, norm string, part bigint, component string, node bigint",
        ).repartition(3)

    return make


@pytest.fixture(scope="session")
def edge(frame):
    return frame(EDGE).cache()


@pytest.fixture(scope="session")
def empty(frame):
    return frame([])


@pytest.fixture(scope="session")
def vocabulary():
    return public_tokenizers.path


@pytest.fixture(scope="session")
def prose():
    """Texts of made-up words with near copies of several strengths."""
    rng = random.Random(5)
    words = ["".join(rng.choice(["ka", "lo", "mi", "ter", "en", "su"]) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    texts = []
    for _ in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(1, 90))]
        texts.append(" ".join(base))
        for changes in rng.sample([0, 1, 1, 2, 3, 6], 3):
            copy = list(base)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy) + rng.choice(["", " ", " extra"]))
    rng.shuffle(texts)
    return [(k, t, "en") for k, t in enumerate(texts)]
