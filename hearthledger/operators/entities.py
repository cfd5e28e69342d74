"""Names, stable ids, quantities and shortened memories, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthledger.functions.memory import LEVELS, fnv1a

# Units of inventories as they are written, and the short forms of some.
UNITS = "天份 日份 天 日 小时 瓶 包 盒 枚 粒 株 份 块 支 套 罐 袋 个 件 把 克 千克 公斤 毫克 毫升 升 g kg mg ml l".split()
SHORT = {"公斤": "kg", "千克": "kg", "克": "g", "毫克": "mg", "毫升": "ml", "升": "l", "日份": "天份", "日": "天"}
ABOUT, GONE, SOME, LASTS = "约|大约|大概|近", "已丢弃|已耗尽|已失去|已销毁|已用完|不再持有", "若干", "可维持|维持|天份|日份"
MEASURE = rf"((?:[x×]\s*)?(?:{ABOUT})?\s*(\d+(?:\.\d+)?)\s*({'|'.join(UNITS)}))(?:$|[（(）)\s，,、；;])"
TIMES = r"([x×]\s*(\d+(?:\.\d+)?))(?:$|[（(）)\s，,、；;])"
USED = "已使用|已安装|已丢弃|已耗尽|已失去|已销毁|已用完|不再持有|已接种|已播种|剩余|新建|运行中"
# Endings that are no part of an item's name, in the order in which they are taken off.
ENDINGS = [
    rf"[（(][^（）()]*(?:{USED})[^（）()]*[）)]\s*$",
    rf"[（(](?:{ABOUT})?\s*\d+(?:\.\d+)?\s*(?:{'|'.join(UNITS)})[）)]\s*$",
    r"[x×]\s*\d+(?:\.\d+)?\s*$",
    rf"[x×]?\s*(?:{ABOUT})?\s*\d+(?:\.\d+)?\s*(?:{'|'.join(UNITS)})\s*$",
    r"若干(?:[（(].*?[）)])?\s*$",
]
DIRECTIONS = {"increase": "获得|增加|补充|收到|拾取|找到|购入|新增", "decrease": "消耗|喝掉|吃掉|用掉|减少|失去|丢失|损坏", "remove": "丢弃|耗尽|失去|销毁|用完|不再持有"}  # fixed values


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def uri_part(text: Column) -> Column:
    """Percent-encoded as a URI component: marks that such components may hold stay."""
    out = F.url_encode(text)
    for code, mark in (("\\+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.regexp_replace(out, code, mark)
    return out


def graph_node_id(chat: Column, entity: Column) -> Column:
    return F.concat(F.lit("graph-node:"), uri_part(chat), F.lit(":"), uri_part(collapsed(F.coalesce(entity, F.lit("")))))


def _lanes(text: Column) -> list[Column]:
    """Four FNV-1a hashes as eight hex digits each, of the text followed by NUL and the variant."""
    return [F.lower(F.lpad(F.hex(fnv1a(F.concat(text, F.lit(f"\0{v}")))), 8, "0")) for v in range(4)]


def named_uuid(text: Column) -> Column:
    """The four lanes in the shape of a name-based UUID."""
    h = F.concat(*_lanes(text))
    at = lambda a, n: F.substring(h, a, n)
    variant = F.conv(at(17, 4), 16, 10).cast("int").bitwiseAND(F.lit(0x3FFF)).bitwiseOR(F.lit(0x8000))
    return F.concat(at(1, 8), F.lit("-"), at(9, 4), F.lit("-5"), at(14, 3), F.lit("-"), F.lower(F.lpad(F.hex(variant.cast("long")), 4, "0")), F.lit("-"), at(21, 12))


def actor_owner_id(workspace: str, name: Column) -> Column:
    return F.concat(F.lit("owner:actor:"), named_uuid(F.concat(F.lit(f"{workspace}\0"), F.lower(F.trim(name)))))


def location_id(workspace: str, name: Column) -> Column:
    return F.concat(F.lit("location:"), named_uuid(F.concat(F.lit(f"{workspace}\0location\0"), F.lower(collapsed(name)))))


def evidence_id(fact: Column, source: Column, excerpt: Column) -> Column:
    """The fact, and FNV-1a of source and excerpt in base 36."""
    return F.concat_ws(":", F.lit("evidence"), fact.cast("string"), F.lower(F.conv(fnv1a(F.concat_ws("\n", source, excerpt)).cast("string"), 10, 36)))


def item_name(text: Column) -> Column:
    """An item's name without its state, quantity and unit."""
    out = text
    for end in ENDINGS:
        out = F.regexp_replace(out, f"(?i){end}", "")
    return F.lower(collapsed(out))


def quantity(text: Column) -> dict[str, Column]:
    """Amount, unit, precision, measure and operation of an item as it is written; an amount outside brackets goes first."""
    outer = F.regexp_extract(text, r"^[^（(]*", 0)
    where = F.when(F.regexp_like(outer, F.lit(r"\d")), outer).otherwise(text)
    measured = F.regexp_extract(where, f"(?i){MEASURE}", 2) != ""
    pick = lambda k: F.when(measured, F.regexp_extract(where, f"(?i){MEASURE}", k)).otherwise(F.regexp_extract(where, f"(?i){TIMES}", k))
    known = ~F.regexp_like(text, F.lit(SOME)) & (pick(2) != "")
    unit = F.lower(F.when(measured, F.regexp_extract(where, f"(?i){MEASURE}", 3)).otherwise("个"))
    short = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in SHORT.items() for x in kv)), unit), unit)
    unit = F.when(known, short).otherwise("")
    exact = F.when(~known, "unknown").when(F.regexp_like(pick(1), F.lit(ABOUT)), "approximate").otherwise("exact")
    measure = F.when(known & (F.regexp_like(text, F.lit(LASTS)) | (unit == "天份")), "coverage_days").otherwise("quantity")
    return {"amount": F.when(known, pick(2).cast("double")), "unit": unit, "precision": exact, "measure": measure, "operation": F.when(F.regexp_like(text, F.lit(GONE)), "remove").otherwise("set")}


def operation_supported(operation: Column, excerpt: Column) -> Column:
    """Whether the excerpt has a word for the direction of the operation; other operations need none."""
    out = F.lit(True)
    for name, cue in DIRECTIONS.items():
        out = F.when(operation == name, F.regexp_like(excerpt, F.lit(cue))).otherwise(out)
    return out


def gist(content: Column) -> Column:
    """The first sentence, always shortened; a lossy form on purpose."""
    whole = collapsed(content)
    first = F.trim(F.element_at(F.split(whole, "[。！？!?；;]"), 1))
    s = F.when(first == "", whole).otherwise(first)
    n = F.length(s)
    most = F.least(F.lit(72), F.greatest(F.lit(3), F.ceil(n * 0.72)))
    keep = F.when(n <= 3, F.greatest(F.lit(1), n - 1)).when(n > most, F.greatest(F.lit(2), most - 1)).otherwise(F.greatest(F.lit(2), n - 1))
    return F.when(whole == "", "一段相关记忆").otherwise(F.concat(F.substring(s, F.lit(1), keep.cast("int")), F.lit("…")))


def fragment(subject: Column, predicate: Column) -> Column:
    return F.concat(F.lit("隐约记得「"), subject, F.lit("」与「"), predicate, F.lit("」有关，细节不清。"))


def packet(content: Column, subject: Column, predicate: Column, strength: Column) -> Column:
    """What is recalled at a strength: the content, its gist, a fragment, or nothing."""
    vague = F.concat(F.lit("对「"), subject, F.lit("」有一段模糊印象。"))
    return F.when(strength <= 0, F.lit(None)).when(strength >= LEVELS["exact"], content).when(strength >= LEVELS["gist"], gist(content)).when(strength >= LEVELS["fragment"], fragment(subject, predicate)).otherwise(vague)


def floor_range(start: Column, end: Column) -> Column:
    one = F.coalesce(start, end)
    return F.when(one.isNull(), "楼层未知").when(start.isNull() | end.isNull() | (start == end), F.concat(F.lit("第 "), one, F.lit(" 层"))).otherwise(F.concat(F.lit("第 "), start, F.lit("–"), end, F.lit(" 层")))


def event_title(summary: Column, start: Column, end: Column) -> Column:
    """A summary up to its first mark beyond the sixth character, else its first 26 characters."""
    s = F.trim(summary)
    at = F.length(F.regexp_extract(s, "^[^，。；]*", 0))
    title = F.when((at < F.length(s)) & (at > 5), F.substring(s, F.lit(1), at)).otherwise(F.substring(s, 1, 26))
    full = F.when(F.length(title) < F.length(s), F.concat(title, F.lit("…"))).otherwise(title)
    return F.when(F.coalesce(s, F.lit("")) == "", F.concat(floor_range(start, end), F.lit("事件"))).otherwise(full)


def embedding_text(kind, subject, predicate, object_, content) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("类型："), kind), F.concat(F.lit("主体："), subject), F.concat(F.lit("谓词："), predicate), F.concat(F.lit("对象："), object_), F.concat(F.lit("事实："), content))


def channel(kind, mode, privacy, speaker, owners) -> Column:
    """How an observation reached its owner; privacy goes before mode."""
    shut = privacy.isin("private", "secret") & speaker
    out = F.when(kind.isin("worldbook", "host_card"), "worldbook").when(kind == "state", "state").when(shut, "private_thought").when(mode.isin("self_reported", "heard"), "public_speech")
    return out.when(mode.isin("believed", "suspected"), "rumor").when(mode == "inferred", "inference").when((mode == "experienced") & owners, "state").otherwise("narration")
