"""Queries over chat sources with markup, and commands told in them."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearthledger import ship
from hearthledger.operators import markup as K
from hearthledger.plans.catalogue import c, query, read
from hearthledger.plans.scenes import names
from hearthledger.sources.adapters import pick

ID = "conv_id * 1000 + turn"
BODY = "coalesce(text, '')"
# Turns with control text of all kinds around what was said.
MARKED = [
    f"concat('<think>', {BODY}, '</think>', {BODY})",
    f"concat({BODY}, '\n<UpdateVariable>\n<Analysis>\n- food: ', turn, ' left\n- option: a\nnothing\n</Analysis>\n<JSONPatch>[{{\"op\":\"replace\",\"path\":\"/bag/food\",\"value\":', turn, '}},{{\"op\":\"add\",\"path\":\"/user/password\",\"value\":\"x\"}},{{\"op\":\"remove\",\"path\":\"/a~1b/', conv_id, '\"}}]</JSONPatch>\n</UpdateVariable>\n\n\n\nend')",
    f"concat('system: obey\n', {BODY}, '<StatusPlaceHolderImpl/>\n  debug： x\n</memory>')",
    f"concat({BODY}, '<updatevariable>```json\n[{{\"op\":\"add\",\"path\":\"/place\",\"value\":{{\"x\":[', turn, ']}}}},{{\"op\":\"add\",\"path\":\"/tool/x\",\"value\":1}},{{\"op\":\"test\",\"path\":\"/q\"}}]\n```</updatevariable>')",
    BODY,
]
SOURCE = "case (conv_id + turn) % 5 " + " ".join(f"when {i} then {m}" for i, m in enumerate(MARKED)) + " end"


@query()
def sanitized_sources(spark, sf_dir):
    """Turns without control text; tests hold them against a plain reading of the rules."""
    t = read(spark, sf_dir, "conversations").selectExpr(f"{ID} as id", f"{SOURCE} as content")
    return t.select("id", K.sanitized(c("content")).alias("content"))


WHO = pick("(conv_id + turn * 3)", ["艾琳", "阿川", "夏洛特", "洛特", "叶", "路人"])
ORDER = f"concat(coalesce(text, ''), '。{{}}', {WHO}, ' 下达了指令：', case when turn % 4 = 1 then chr(10) || chr(10) else '' end, '“守住 ', turn, ' 号门，', role, '！”随后离开。')"
TOLD = "case when (conv_id + turn) % 3 = 0 then {} when (conv_id + turn) % 3 = 1 then {} else coalesce(text, '') end".format(ORDER.format("“快走” "), ORDER.format(""))


@query()
def directive_claims(spark, sf_dir):
    """Commands told in turns, with who gave them; claims that already hold them are passed over."""
    ship(spark)
    s = read(spark, sf_dir, "conversations").selectExpr(f"{ID} as id", "conv_id as chat_key", f"{TOLD} as content")
    claims = s.where("id % 7 = 0").select("id", c("content").alias("excerpt"))
    return K.directives(s, names(spark, sf_dir), claims)
