"""Speakers of lines, leaked and used memories: literal cases, and plain loops over random chats."""

import random

from hearthledger.operators import usage as U

OUT, OWN, PACK = "output_id int, chat_key int, text string", "chat_key int, owner_id string, name string", "packet_id int, chat_key int, owner_id string, marker string"


def test_speakers(spark):
    outputs = [(1, 1, "Ann: hello\n  **Bob**： hi\nno one\n[ann]: again\nEve: x\r\n【bob】：bye"), (2, 1, None), (3, 2, "Ann: hello"), (4, 1, "")]
    owners = [(1, "a", "Ann"), (1, "b", "Bob"), (1, "c", "bob")]
    got = sorted((r.output_id, r.owner_id, r.text) for r in U.spoken(spark.createDataFrame(outputs, OUT), spark.createDataFrame(owners, OWN)).collect())
    assert got == [(1, "a", "hello\nagain"), (1, "b", "hi\nbye")]


def test_leaks_and_use(spark):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(30)] + ["é", "钟楼", "a"]
    phrase = lambda n: " ".join(rng.choices(words, k=n))
    owners = [(ch, o, n) for ch in (1, 2) for o, n in (("a", "Ann"), ("b", "Bob"))]
    packets = [(i, rng.choice([1, 2]), rng.choice("ab"), phrase(rng.randrange(1, 6))) for i in range(60)] + [(90, 1, "a", None), (91, 1, "a", "")]
    lines = lambda: "\n".join(f"{rng.choice(['Ann: ', 'Bob: ', '', 'Eve: '])}{phrase(rng.randrange(0, 3))} {rng.choice(packets)[3] or ''} {phrase(2)}" for _ in range(4))
    outputs = [(i, rng.choice([1, 2]), lines()) for i in range(25)]
    said = {}
    for i, ch, text in outputs:
        for line in text.split("\n"):
            for o, n in (("a", "Ann: "), ("b", "Bob: ")):
                if line.startswith(n) and line[len(n) :].strip():
                    said.setdefault((i, ch, o), []).append(line[len(n) :].strip())
    said = {k: "\n".join(v) for k, v in said.items()}
    leaks = {(i, o, w, m) for (i, ch, o), t in said.items() for _, of, w, m in packets if m and len(m) >= 6 and of == ch and w != o and m in t}
    use = {}
    for p, of, w, m in packets:
        explicit = m and len(m) >= 6 and any(ch == of and o == w and m in t for (_, ch, o), t in said.items())
        implicit = m and len(m) >= 8 and any(ch == of and m in t for _, ch, t in outputs)
        use[p] = "explicit" if explicit else "implicit" if implicit else "not_used"
    o, k = spark.createDataFrame(outputs, OUT), spark.createDataFrame(packets, PACK)
    spoken = U.spoken(o, spark.createDataFrame(owners, OWN))
    assert {(r.output_id, r.chat_key, r.owner_id): r.text for r in spoken.collect()} == said
    assert {tuple(r) for r in U.leaks(spoken, k).collect()} == leaks
    assert {r.packet_id: r.usage for r in U.used(o, spoken, k).collect()} == use
    assert len(set(use.values())) == 3 and leaks
