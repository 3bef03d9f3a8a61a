import random

import pytest

from sparkloom.llm.queries import QUERIES

NAMES = ["hash", "slot", "halo", "shard", "n_tokens", "fp", "text_hash", "features", "score", "key", "t", "mask", "n", "quality", "label", "at", "p", "ids", "path", "start", "held_out", "dtype"]


@pytest.mark.parametrize("name", [q for q in QUERIES if q.split("_")[0] in ("op1", "op2", "op6", "op9", "op10")])
def test_columns_of_any_name_change_nothing(docs, spark, tmp_path, name):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)] + ["é", "Ω", "\n"]
    rows = [(i if i % 11 else None, " ".join(rng.choices(words, k=rng.randint(0, 80))) if i % 13 else None) for i in range(60)] + [(7, "twice"), (7, "twice")]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int")
    found = []
    for folder, extra in (("plain", []), ("more", [f"concat('{n}', doc_id) AS {n}" for n in NAMES])):
        docs(rows).selectExpr("*", *extra).write.parquet(f"{tmp_path}/{folder}/documents.parquet")
        labels.selectExpr("*", *([f"1 AS {n}" for n in ("label", "draw", "features")] if extra else [])).write.parquet(f"{tmp_path}/{folder}/labels.parquet")
        df = QUERIES[name](spark, f"{tmp_path}/{folder}")
        found.append((df.columns, sorted(map(str, df.collect()))))
    assert found[0] == found[1] and len(found[0][1]) == len(rows)
