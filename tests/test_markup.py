"""Sanitised sources and told commands against plain readings of the rules."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from hearthledger.operators import markup as K


def plain(text):
    """The rules, one block after another."""
    text = re.sub("\r\n?", "\n", text)

    def lines(m):
        inner, out = m[1], []
        for block in re.findall(K.ANALYSIS, inner):
            for x in map(str.strip, block.split("\n")):
                if re.search(K.SHAPED, x) and re.search(K.TELLS, x) and not re.search(K.STEERS, x) and not re.search(K.TAGGED, x):
                    out.append(K.EXPLAINED + re.sub(r"^[-*]\s*", "", x))
        bare = re.sub(K.PATCH, "", re.sub(K.ANALYSIS, "", inner)).strip()
        bare = re.sub(r"\s*```$", "", re.sub(r"(?i)^```(?:json)?\s*", "", bare)).strip()
        for block in [*re.findall(K.PATCH, inner), *([bare] if bare.startswith("[") and bare.endswith("]") else [])]:
            try:
                ops = json.loads(block)
            except ValueError:
                continue
            for o in ops:
                op, path = o.get("op", "").lower(), o.get("path", "")
                keys = [k.replace("~1", "/").replace("~0", "~") for k in path.split("/") if k]
                if op not in ("add", "replace", "remove") or path[:1] != "/" or not keys or re.search(K.STEERED, path) or re.search(K.UNSAFE, path):
                    continue
                if any(re.search(p, re.sub(r"[\s_.:/\\-]+", "", k.strip())) for k in keys for p in (K.SECRET_NAME, K.SECRET_END)):
                    continue
                v = o.get("value")
                said = K.REMOVED if op == "remove" else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False, separators=(",", ":"))
                if op != "remove" and ("value" not in o or not said or re.search(K.TAGGED, said) or re.search(K.SECRET_VALUES, said)):
                    continue
                out.append(f"{K.UPDATED}{' / '.join(keys)}：{said if len(said) <= K.LONGEST or op == 'remove' else said[: K.LONGEST] + '…'}")
        return "\n".join(out)

    text = re.sub(K.UPDATE, lines, text)
    for p in (*K.BLOCKS, *K.TAGS, *K.HEADS):
        text = re.sub(p, "", text)
    return re.sub("\n{3,}", "\n\n", text).strip()


PIECES = [
    "said\r\n", "<think>no\n</think>", "</tool>", "<Debug x=1>", "\n\n\n\n", "SYSTEM: go\n", " stx_memory：x\n", "说 “好”。", "<StatusPlaceHolderImpl />",
    "<UpdateVariable><Analysis>\n- food: 3\n* water left\nplain\n状态：好\n- option: food\n</Analysis></UpdateVariable>",
    '<UpdateVariable a="b"><JSONPatch>[{"op":"add","path":"/a/b~1c","value":{"x":[1,"y"]}},{"op":"REMOVE","path":"/z"},{"op":"add","path":"/api_key","value":"q"},{"op":"add","path":"nope","value":1}]</JSONPatch></UpdateVariable>',
    '<updatevariable>```json\n[{"op":"replace","path":"/hp","value":"low"},{"op":"add","path":"/tool/x","value":1},{"op":"add","path":"/k","value":"Bearer abcdefghijklmnop"},{"op":"add","path":"/n","value":null}]\n```</updatevariable>',
    "<UpdateVariable>nothing to say</UpdateVariable>", '<UpdateVariable><JSONPatch>broken [</JSONPatch></UpdateVariable>', '<UpdateVariable>[{"op":"add","path":"/long","value":"' + "é" * 1_200 + '"}]</UpdateVariable>',
]


def test_sanitized(spark):
    rng = random.Random(7)
    texts = [*PIECES, *("".join(rng.choices(PIECES, k=rng.randrange(1, 7))) for _ in range(150)), ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "id int, content string")
    got = {r.id: r.out for r in df.select("id", K.sanitized(F.col("content")).alias("out")).collect()}
    assert got.pop(-1) is None
    for i, t in enumerate(texts):
        assert got[i] == plain(t), t


@pytest.mark.parametrize(
    "text, want",
    [
        ("艾琳下达指令：“守住大门”。", [("艾琳", "守住大门")]),
        ("“快走”艾琳下令：“守住”", [("艾琳", "快走；守住")]),
        ("艾琳下达了命令：\n\n“守住大门”", []),
        ("艾琳下令" + "远" * 241 + "“守住大门”", []),
        ("“守住大门”" + "，" * 181 + "艾琳命令道", []),
        ("艾琳命令道：“……”", []),
        ("没有人", []),
        ("", []),
    ],
)
def test_directives_in(text, want):
    assert [(n, w) for n, _, _, w in K.directives_in(text)] == want


def test_directives_of_known_owners(spark):
    sources = spark.createDataFrame([(1, 1, "林川下达指令：“校准阵列”"), (2, 1, "川流下令：“切换航道”"), (3, 1, "小川下令：“全体撤退！”"), (4, 2, "林川下达指令：“校准阵列”"), (5, 1, None), (6, 1, "林川下令：“重复的指令”")], "id int, chat_key int, content string")
    names = spark.createDataFrame([(1, "a", "林川"), (1, "b", "大川流"), (1, "c", "老小川"), (1, "d", "新小川"), (2, "e", "林川"), (2, "f", "林川")], "chat_key int, owner_id string, name string")
    claims = spark.createDataFrame([(6, "他说 林川下令：“重复的指令” 完")], "id int, excerpt string")
    got = sorted((r.id, r.owner_id, r.words) for r in K.directives(sources, names, claims).collect())
    assert got == [(1, "a", "校准阵列"), (2, "b", "切换航道")]
