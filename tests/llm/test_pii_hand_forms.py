"""What the trained model finds in forms written by hand, which its training windows do not come from."""

from __future__ import annotations

from collections import Counter

from hand_forms import CLEAN, FOUND

from recallium.llm import pii

PAD = "lorem ipsum dolor sit amet and so on for a while in the text "
#: Of 8, 5, 5 and 8: found when this was written, less one.
FLOOR = {"email": 5, "ip": 3, "card": 4, "phone": 4}


def test_recall_by_kind_and_wrong_spans(spark):
    p = pii.train_model(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    hit, wrong = Counter(), 0
    for kind, text, want in FOUND:
        full = f"{PAD}{text} {PAD}"
        ((base, every),) = pii.find_spans(p, [full])
        at = full.index(want)
        span = (at, pii.KINDS.index(kind), at + len(want))
        hit[kind] += span in every
        wrong += sum(s != span and s not in base for s in every)
    for text in CLEAN:
        ((base, every),) = pii.find_spans(p, [f"{PAD}{text} {PAD}"])
        wrong += len(every) - len(base)
    assert all(hit[k] >= n for k, n in FLOOR.items()), hit
    assert wrong <= 4
