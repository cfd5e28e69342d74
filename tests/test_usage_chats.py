"""Memories met by chat: few markers at once, many by their rarest piece."""

import pytest

from hearthledger.operators import usage as U
from tests import test_usage as T
from tests.test_usage import OUT, OWN, PACK


@pytest.mark.parametrize("direct", [0, 3, 256])
def test_markers_meet_texts_of_their_own_chat(spark, monkeypatch, direct):
    monkeypatch.setattr(U, "DIRECT", direct)
    T.test_leaks_and_use(spark)
    # Packets of two chats that share a number: each is met in its own chat only.
    packets = [(1, 1, "a", "the red door"), (1, 2, "a", "a blue lamp"), (2, 2, "b", "lampshade"), (3, 1, "b", "ed do"), (4, 3, "a", "the red door"), (5, 1, None, "the red door")]
    outputs = [(1, 1, "Bob: a blue lamp\nAnn: nothing"), (2, 2, "Bob: xa blue lampshadey\nAnn: thered door"), (3, 1, "Ann: see the red doors")]
    o, k = spark.createDataFrame(outputs, OUT), spark.createDataFrame(packets, PACK)
    spoken = U.spoken(o, spark.createDataFrame([(ch, w, n) for ch in (1, 2) for w, n in (("a", "Ann"), ("b", "Bob"))], OWN))
    assert {tuple(r) for r in U.leaks(spoken, k).collect()} == {(2, "b", "a", "a blue lamp")}
    assert {r.packet_id: r.usage for r in U.used(o, spoken, k).collect()} == {1: "explicit", 2: "explicit", 3: "not_used", 4: "not_used", 5: "implicit"}
