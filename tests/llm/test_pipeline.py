import random

import numpy as np
import public_tokenizers as P
from llm_helpers import doc, frame, odd_rows, prose
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from fillwise.llm import common


def planted():
    rnd = random.Random(11)
    clean = [doc(i, prose(rnd, rnd.randint(60, 250), lang), lang, f"s{i % 2}") for i, lang in ((i, ("en", "de")[i % 2]) for i in range(200))]
    passage = prose(rnd, 120)
    clean[10], clean[12] = (doc(i, prose(rnd, 80) + "\n" + passage + "\n" + prose(rnd, 80), "en", "s0") for i in (10, 12))
    copies = [doc(500 + k, clean[k][1], "en", "s0") for k in (0, 2, 4)]
    junk = [doc(600 + k, " ".join(w + "###" for w in prose(rnd, 90).split()), "en", "s0") for k in range(6)] + [doc(650, "same word " * 80), doc(651, "short")]
    return clean, copies, junk, passage


def test_each_stage_takes_effect(spark):
    clean, copies, junk, passage = planted()
    docs = frame(spark, clean + copies + junk + odd_rows()[:3], clashing=True)
    folder, columns, seen = common.shared_folder(spark, "pipeline-test"), docs.columns, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        seen.append(docs)
        assert k == 4 or docs.columns == columns, name
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert not ids[0] & {r[0] for r in junk}                                      # quality: junk goes
    assert len(ids[1] & {r[0] for r in clean}) >= 198                              # clean documents stay
    assert not ids[2] & {r[0] for r in copies} and ids[1] - ids[2] <= {r[0] for r in copies}
    text = {r.doc_id: (r.text, r.n_chars) for r in seen[3].select("doc_id", "text", "n_chars").collect()}
    assert passage[10:-10] not in text[10][0] + text[12][0] and all(n == len(t) for t, n in text.values())
    assert text[10][0].split("\n")[0][:200] == clean[10][1][:200]
    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    parts = {}
    for r in seen[4].collect():
        parts.setdefault(r.doc_id, []).append((r.start, np.frombuffer(bytes(r.ids), "<u4").tolist()))
    for i, (s, _) in text.items():
        assert sum((p for _, p in sorted(parts[i])), []) == t.encode(s, add_special_tokens=False).ids + [1]


def test_registered():
    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13 and "pipeline" in names
    assert len(corpus_pipeline.STAGES) == 5


def test_passages_of_over_fifty_words_go_from_all_documents_and_clean_texts_stay(spark):
    rnd = random.Random(12)
    passages = [prose(rnd, n) for n in (51, 51, 52, 55, 60, 64, 80, 150) for _ in range(3)]
    clean = [doc(i, prose(rnd, rnd.randint(60, 300), rnd.choice(["en", "de", "fr"]))) for i in range(80)]
    holders, held = [], []
    for k, p in enumerate(passages):
        for j in range(rnd.choice([2, 2, 3, 9])):
            before, after = prose(rnd, rnd.randint(1, 80)), prose(rnd, rnd.randint(1, 80))
            holders.append(doc(1000 + len(holders), before + "\n" + p + "\n" + after))
            held.append((before, p, after))
    out = {r.doc_id: r.text for r in corpus_pipeline.suffix_array_dedup(spark, frame(spark, clean + holders), "").collect()}
    assert all(out[r[0]] == r[1] for r in clean)
    for row, (before, p, after) in zip(holders, held):
        left = out[row[0]]
        # Bytes beside a passage that chance to be equal elsewhere go with it.
        assert p[12:-12] not in left and left.startswith(before[:-12]) and left.endswith(after[12:]), (p, left)
        assert len(left) - len(before) - len(after) < 12


def test_empty_table_through_all_stages(spark, tmp_path):
    frame(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
