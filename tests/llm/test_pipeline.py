import random
import tempfile

import corpus_pipeline
from quantloom.llm.queries import oracle_sql, queries
from quantloom.llm.ring import assign_shards


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def planted(spark, path):
    """Documents in two languages with copies, near copies, benchmark passages, toxic ones, texts without letters, nulls and
    repeated rows, under column names that the stages use themselves; and what should become of them."""
    rng = random.Random(12)
    stems = {"aa": ["the", "thing", "where", "ought", "shell"], "bb": ["der", "nicht", "schaft", "ungen", "ich"]}
    toxic_words = ["scum", "vile", "moron", "trash"]

    def words(n, lang):
        return ["".join(rng.choice(stems[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n)]

    item = "pick the one right answer from these nine lines about rivers and stones today please"
    rows, kind = [], {}

    def add(text, lang, what):
        kind[len(rows)] = what
        rows.append((len(rows), text, lang, "s", 1, 2, 3))

    for i in range(240):
        lang = "ab"[i % 2] * 2
        t = words(60, lang)
        if i % 8 == 0:
            for x in toxic_words:
                t[rng.randrange(60)] = x
        add(" ".join(t), lang, "toxic" if i % 8 == 0 else "clean")
    for i in (1, 3, 5):
        add(rows[i][1], rows[i][2], "copy")
        near = rows[i][1].split()
        near[-1] = "zzz"
        add(" ".join(near), rows[i][2], "copy")
    for _ in range(5):
        add(" ".join(words(40, "aa") + item.split() + words(40, "aa")), "aa", "benchmark")
    for t in (None, "", "123 -- 4"):
        add(t, "aa", "no language")
    rows.append(rows[7])  # a row once more
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, _gone int, _bad int, _times int").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, int(k == "toxic")) for i, k in kind.items() if k in ("clean", "toxic")], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows, kind


def test_stages_on_planted_cases(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mixing", "sharding"]
    path = tempfile.mkdtemp(prefix="spark-planted-")
    rows, kind = planted(spark, path)
    docs, text = spark.read.parquet(f"{path}/documents.parquet"), {r[0]: r[1] for r in rows}
    ids = lambda df: sorted(r["doc_id"] for r in df.select("doc_id").collect())
    stage, kept = dict(corpus_pipeline.STAGES), {}
    for name in ("language_id", "near_dedup", "decontamination", "mixing"):
        out = stage[name](spark, docs, path)
        assert out.columns == docs.columns
        docs = spark.createDataFrame(out.collect(), docs.schema)
        kept[name] = ids(docs)
    assert kept["language_id"] == sorted(r[0] for r in rows if kind[r[0]] != "no language")
    # Near-dedup by brute force: of linked documents the smallest id.
    sets = {i: shingles(text[i]) for i in set(kept["language_id"])}
    label = {i: i for i in sets}
    for _ in range(3):
        for a in sorted(sets):
            for b in sorted(sets):
                if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    assert kept["near_dedup"] == sorted(set(label.values())) and not any(kind[i] == "copy" for i in kept["near_dedup"])
    assert kept["decontamination"] == [i for i in kept["near_dedup"] if kind[i] != "benchmark"]
    mixed = kept["mixing"]
    assert {i for i in kept["decontamination"] if kind[i] == "clean"} <= set(mixed)
    assert sum(kind[i] == "toxic" for i in mixed) <= 3
    shards = assign_shards(docs, 24)
    assert ids(shards) == mixed
    out = corpus_pipeline.run(spark, path)
    assert ids(out) == mixed


def test_registered():
    q = queries()
    assert sorted(int(k[2:].split("_")[0]) for k in q) == list(range(1, 14)) and set(oracle_sql()) <= set(q)
