"""The stages one by one against plain Python."""

import random
import re

import corpus_pipeline as pipeline
from test_text_ops import WORDS, frame, prose, slow_classes, slow_hits, spans_of

from cytomill.llm.wordhash import settle


def test_stages(spark, tmp_path):
    r = random.Random(3)
    leak = " ".join(r.choice(WORDS) for _ in range(14))
    clean = [" ".join(f"{prose(r, 9)}." for _ in range(10)) for _ in range(30)]
    texts = [*clean, clean[0], clean[1] + " tail", prose(r, 80).replace(" ", " | "), "short", f"{clean[2]} {leak.upper()} {prose(r, 40)}", f"{prose(r, 60)} password = abcdefgh12 {prose(r, 20)}", None, ""]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    docs = frame(spark, rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([(1, leak), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    seen = {}
    for name, stage in pipeline.STAGES:
        out = settle(stage(spark, docs, str(tmp_path)))
        seen[name] = (docs.collect(), out.collect())
        if name != "piece_ids":
            assert out.columns == docs.columns
        docs = out
    before, after = seen["quality_rules"]
    assert {x.doc_id for x in before} - {x.doc_id for x in after} == {32, 33, 36, 37}
    before, after = seen["near_dedup"]
    assert {x.doc_id for x in after} == set(slow_classes([(x.doc_id, x.text) for x in before]).values()) and len(after) == len(before) - 2
    before, after = seen["decontamination"]
    assert len(after) == len(before) and [x.doc_id for x in after if x.text != dict((b.doc_id, b.text) for b in before)[x.doc_id]] == [34]
    assert all(h[2] == 0 for h in slow_hits([(x.doc_id, x.text) for x in after], [(1, leak)], 10))
    before, after = seen["secret_scan"]
    texts = {b.doc_id: b.text for b in before}
    for x in after:
        assert x.n_chars == len(x.text) and not spans_of(x.text)
        assert x.text == texts[x.doc_id] or (x.doc_id == 35 and re.fullmatch(r".* \[secret\] .*", x.text))
    before, after = seen["piece_ids"]
    assert len(before) == len(after) and all(x.lossless and x.n_pieces == len(x.ids) > 0 for x in after)
    empty = docs_like = settle(pipeline.STAGES[0][1](spark, frame(spark, rows, "doc_id long, text string, lang string, source string, n_chars long").limit(0), str(tmp_path)))
    for _, stage in pipeline.STAGES[1:]:
        empty = settle(stage(spark, empty, str(tmp_path)))
    assert empty.count() == docs_like.count() == 0
