import random

import pytest

CLASHING = "__text string, __m string, __h string, __lang string, __new string, row string, `a.b` string, lang_ string, fingerprint string, sketch string, next_text string, edited string, fp string, node string, component_id string, score string, lang_pred string, spans string, shard string, pretoken string, x string, start string, length string, host string, rule string, kept_ string, g string, `offset` string"


def texts() -> list:
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdeéß") for _ in range(r.randint(1, 6)))
    some = [" ".join(word() for _ in range(r.randint(1, 60))) for _ in range(12)]
    return [
        None,
        "",
        " ",
        "\n\n  \t",
        "a",
        "one two",
        "A b  C d\te\r\nf",
        "  lead and trail  ",
        "▁under  bars ▁",
        "ünï cödé 日本語 \U0001f600 İstanbul ΑΣ Σ",
        "x\x00y \x1c z\x85q　r s",
        "<|endoftext|> <s> </s> <unk>",
        "1.2.3.4 999.1.1.1 a.b@c.de_f@g.hi +1 (222) 555-7777 4111 1111 1111 1111",
        "long " * 30_000,
        "z" * 60_000,
        "|.!" * 20_000,
        *some,
        *some[:4],
        some[5] + " end",
        *["the same text again and again and again"] * 5,
    ]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, copies, a row twice, and columns whose names clash."""
    rows = [(i * 3 - 20 if i < 30 else i * 1_000_003, t, ("en", "fr", None)[i % 3], None if i % 4 else "src", None if i % 5 else len(t or "")) for i, t in enumerate(texts())]
    rows += [rows[17], (None, "no id", None, None, None), (None, None, None, None, None), (-5_000_000_000, "far", "en", "src", 3)]
    names = CLASHING.split(", ")
    df = spark.createDataFrame([r + ("clash",) * len(names) for r in rows], f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}")
    return df.repartition(3)


@pytest.fixture(scope="session")
def empty(spark, odd):
    return spark.createDataFrame([], odd.schema)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
