import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
VOCAB = "the of and to in that is was for it with as his on be at by this had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people mr how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three".split()


def prose(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with copies, near copies, shared passages, nulls, blanks and a very long text."""
    rng = random.Random(3)
    out = []
    base = prose(rng, 120).split()
    passage = prose(rng, 40)
    for i in range(120):
        kind = i % 8
        if kind == 0:
            text = prose(rng, rng.randint(1, 200))
        elif kind == 1:  # near copies, some far from the base
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 6])):
                words[rng.randrange(len(words))] = rng.choice(VOCAB)
            text = " ".join(words)
        elif kind == 2:
            text = f"{prose(rng, 60)}\n{passage} {prose(rng, 30)}"
        elif kind == 3:
            text = ["", None, "   \t\n", "word", "two words", "É é ß", "A\x0bB\x1cC", "one two three four"][i // 8 % 8]
        elif kind == 4:
            text = " ".join(base).upper() if i % 16 == 4 else " ".join(base)
        else:
            text = prose(rng, rng.randint(3, 90))
        out.append((i, text, rng.choice(["en", "de", None]), f"src{i % 3}", len(text or "")))
    out.append((500, prose(rng, 30_000), "en", "src0", 0))
    return out


@pytest.fixture
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def odd(spark):
    """Repeated rows, a null id, nulls everywhere, and columns whose names operators use themselves."""
    rows = [(1, "a b c d e", 0, "x", 1.0), (1, "a b c d e", 0, "x", 1.0), (None, "a b c d e", None, None, None), (2, None, 1, "y", 2.0), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, chunk int, bucket string, rest double").selectExpr("*", "1 as round", "'m' as marks", "0 as n", "false as held")


@pytest.fixture
def none(spark):
    return spark.createDataFrame([], SCHEMA)
