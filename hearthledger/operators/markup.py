"""Chat sources as evidence: control markup taken out, state updates kept as lines, spoken directives found."""

from __future__ import annotations

import bisect
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

c = F.col
# Tags whose blocks are control text, tags that go by themselves, and line heads that are.
HIDDEN = "think|analysis|tool|debug|memory"
BLOCKS = [rf"(?is)<(?:{HIDDEN})\b[^>]*>.*?</(?:{HIDDEN})\s*>", r"(?is)<UpdateVariable\b[^>]*>.*?</UpdateVariable\s*>"]
TAGS = [rf"(?i)</?(?:{HIDDEN}|UpdateVariable|JSONPatch)\b[^>]*>", r"(?i)<StatusPlaceHolderImpl\s*/?>"]
HEADS = [r"(?im)^\s*stx_memory\s*[:：].*$", r"(?im)^\s*(?:system|tool|debug)\s*[:：].*$"]
UPDATE = r"(?is)<UpdateVariable\b[^>]*>(.*?)</UpdateVariable\s*>"
ANALYSIS = r"(?is)<Analysis\b[^>]*>(.*?)</Analysis\s*>"
PATCH = r"(?is)<JSONPatch\b[^>]*>(.*?)</JSONPatch\s*>"
# Analysis lines that tell a state, what bars a line, a path or a value.
SHAPED = r"^(?:[-*]\s+\S+|[^:：\n]{1,80}[:：]\s*\S)"
TELLS = r"(?i)(?:\b(?:state|status|inventory|(?:(?:low|medium|high|special)\s+)?cores?|member|weapon|food|water|day|location|relationship|goal)\b|状态|储备|库存|成员|武器|食物|饮用水|天数|位置|关系|目标|剩余|数量|更新)"
STEERS = r"(?i)(?:\b(?:fate\s*branches?|option|prompt|instruction|system|tool|debug|reasoning|nsfw)\b|命运分支|选项|提示词|系统|工具|调试|推理)"
STEERED = r"(?i)(?:^|/)(?:命运分支|选项[^/]*|fate(?:_|\s|-)*branches?|options?|prompt|instruction|system|tool|debug|reasoning|analysis|nsfw)(?:/|$)"
UNSAFE = r"(?:^|/)(?:__proto__|prototype|constructor)(?:/|$)"
TAGGED = rf"(?i)</?(?:{HIDDEN}|UpdateVariable|JSONPatch|StatusPlaceHolderImpl)\b"
SECRET_NAME = "(?i)^(?:api(?:key)?|apikey|access(?:token)?|refreshtoken|authtoken|authorization|bearer|password|passwd|pwd|secretkey|clientsecret|privatekey|cookie|session(?:id|token)?|credential|credentials|密钥|令牌|密码|口令|凭据|认证信息|授权信息|会话令牌)$"
SECRET_END = "(?i)(?:apikey|accesstoken|refreshtoken|authtoken|authorization|password|passwd|secretkey|clientsecret|privatekey|sessiontoken|credential|credentials|密钥|令牌|密码|口令|凭据|认证信息|授权信息|会话令牌)$"
SECRET_VALUES = r"-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----|(?i:\b(?:Bearer|Basic)\s+[A-Za-z0-9._~+/-]{12,}={0,2})|(?i:\b(?:sk|rk|pk|ghp|github_pat|glpat|xox[baprs])-?[A-Za-z0-9_-]{16,}\b)|\bAIza[0-9A-Za-z_-]{20,}\b|\bAKIA[0-9A-Z]{16}\b"
LONGEST = 1_000  # characters of a value in a line
EXPLAINED, UPDATED, REMOVED = "状态说明：", "状态更新：", "已移除"


def _has(x: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_like(x, F.lit(pattern)), F.lit(False))


def _all(x: Column, pattern: str) -> Column:
    return F.regexp_extract_all(x, F.lit(pattern), F.lit(1))


def analysis_lines(inner: Column) -> Column:
    """Lines of analysis blocks that tell a state."""
    lines = F.flatten(F.transform(_all(inner, ANALYSIS), lambda b: F.transform(F.split(b, "\n"), lambda x: F.trim(x))))
    told = F.filter(lines, lambda x: _has(x, SHAPED) & _has(x, TELLS) & ~_has(x, STEERS) & ~_has(x, TAGGED))
    return F.transform(told, lambda x: F.concat(F.lit(EXPLAINED), F.regexp_replace(x, r"^[-*]\s*", "")))


def patch_lines(inner: Column) -> Column:
    """Operations of JSON patches as lines of path and value; control, unsafe and secret paths and secret values are left out."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(inner, ANALYSIS, ""), PATCH, ""))
    bare = F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", ""))
    lone = F.when(F.startswith(bare, F.lit("[")) & F.endswith(bare, F.lit("]")), F.array(bare)).otherwise(F.array().cast("array<string>"))
    ops = F.flatten(F.transform(F.concat(_all(inner, PATCH), lone), lambda t: F.coalesce(F.from_json(t, "array<struct<op: string, path: string, value: variant>>"), F.array().cast("array<struct<op: string, path: string, value: variant>>"))))

    def line(o: Column) -> Column:
        op, path = F.lower(o["op"]), o["path"]
        keys = F.transform(F.filter(F.split(path, "/"), lambda k: k != ""), lambda k: F.replace(F.replace(k, F.lit("~1"), F.lit("/")), F.lit("~0"), F.lit("~")))
        value = F.coalesce(F.try_variant_get(o["value"], "$", "string"), F.to_json(o["value"]))
        plain = F.when(F.startswith(F.to_json(o["value"]), F.lit('"')), value).otherwise(F.to_json(o["value"]))
        short = F.when(F.length(plain) > LONGEST, F.concat(F.substring(plain, 1, LONGEST), F.lit("…"))).otherwise(plain)
        flat = F.transform(keys, lambda k: F.regexp_replace(F.trim(k), r"[\s_.:/\\-]+", ""))
        secret = F.exists(flat, lambda k: _has(k, SECRET_NAME) | _has(k, SECRET_END))
        fine = op.isin("add", "replace", "remove") & F.startswith(path, F.lit("/")) & ~_has(path, STEERED) & ~_has(path, UNSAFE) & ~secret & (F.size(keys) > 0)
        said = F.when(op == "remove", F.lit(REMOVED)).when((plain != "") & ~_has(plain, TAGGED) & ~_has(plain, SECRET_VALUES), short)
        return F.when(fine, F.concat(F.lit(UPDATED), F.array_join(keys, " / "), F.lit("："), said))

    return F.filter(F.transform(ops, line), lambda x: x.isNotNull())


def sanitized(text: Column) -> Column:
    """A source without hidden reasoning and control text; updates of variables become lines that a reader can follow.  Null stays null."""
    text = F.regexp_replace(text, "\r\n?", "\n")
    kept = F.transform(_all(text, UPDATE), lambda inner: F.array_join(F.concat(analysis_lines(inner), patch_lines(inner)), "\n"))
    between = F.split(text, UPDATE)
    text = F.array_join(F.transform(between, lambda x, i: F.concat(x, F.coalesce(F.get(kept, i), F.lit("")))), "")
    for pattern in (*BLOCKS, *TAGS, *HEADS):
        text = F.regexp_replace(text, pattern, "")
    return F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


# ---------------------------------------------------------------- directives
ORDERS = re.compile(r"([一-鿿㐀-䶿·]{1,20})\s*(?:下达了?(?:指令|命令)|下令(?:道)?|命令道)")  # fixed values: how a command is told
QUOTED = re.compile("“([^”]{2,400})”")
APART = re.compile(r"\r?\n\s*\r?\n")
BEFORE, AFTER, SEEN_BEFORE, SEEN_AFTER = 180, 240, 500, 700  # characters from a command's words to what was said, and how far speech may reach
SPAN = (8, 1_200)


def directives_in(text: str) -> list[tuple[str, int, int, str]]:
    """(name, start, end, words) of each told command: who gave it, where it stands, and what was said, the speech before and after joined by ；.

    Speech belongs to a command if it is the nearest on its side, close enough, whole within reach and in the same paragraph.
    """
    said = [(m.start(), m.end(), m[1].strip()) for m in QUOTED.finditer(text)]
    begins, ends = [s[0] for s in said], [s[1] for s in said]
    found = []
    for told in ORDERS.finditer(text):
        at, to = told.span()
        left, right = bisect.bisect_right(ends, at) - 1, bisect.bisect_left(begins, to)
        sides = []
        if left >= 0 and begins[left] >= at - SEEN_BEFORE and at - ends[left] <= BEFORE and not APART.search(text, ends[left], at):
            sides.append(said[left])
        if right < len(said) and ends[right] <= to + SEEN_AFTER and begins[right] - to <= AFTER and not APART.search(text, to, begins[right]):
            sides.append(said[right])
        sides = [s for s in sides if any(x.isalnum() for x in s[2])]
        if sides:
            start, end = min(at, sides[0][0]), max(to, sides[-1][1])
            if SPAN[0] <= end - start <= SPAN[1]:
                found.append((told[1].strip(), start, end, "；".join(s[2] for s in sides)))
    return found


def directives(sources: DataFrame, names: DataFrame, claims: DataFrame) -> DataFrame:
    """(id, chat_key, owner_id, start, end, words): commands in `sources` (id, chat_key, content) by owners that `names` (chat_key, owner_id, name) tells for certain.

    A name is an owner's if it is that owner's alone, or else, of two characters or more, the ending of one owner's names only.  Commands whose words
    and excerpt a claim of the same source (`claims`: id, excerpt) already holds are left out.  Null and empty texts have none.
    """

    def cut(batches):
        for pdf in batches:
            rows = [(i, chat, *d, t[d[1] : d[2]]) for i, chat, t in zip(pdf["id"], pdf["chat_key"], pdf["content"], strict=True) if t for d in directives_in(t)]
            yield pd.DataFrame(rows, columns=["id", "chat_key", "name", "start", "end", "words", "excerpt"])

    kinds = dict(sources.dtypes)
    told = sources.select("id", "chat_key", "content").mapInPandas(cut, f"id {kinds['id']}, chat_key {kinds['chat_key']}, name string, start long, end long, words string, excerpt string")
    own = names.where("name <> ''").select("chat_key", "owner_id", F.lower("name").alias("name")).distinct()
    only = lambda d: d.groupBy("chat_key", "name").agg(F.min("owner_id").alias("owner_id"), F.count_distinct("owner_id").alias("n"))
    whole = only(own)
    tails = own.where(F.length("name") > 2).select("chat_key", "owner_id", F.explode(F.transform(F.sequence(F.lit(2), F.length("name") - 1), lambda k: F.right(c("name"), k))).alias("name"))
    ending = only(tails).select("chat_key", "name", c("owner_id").alias("tail_id"), c("n").alias("tail_n"))
    told = told.withColumn("name", F.lower("name")).join(whole, ["chat_key", "name"], "left").join(ending, ["chat_key", "name"], "left")
    told = told.withColumn("owner_id", F.when(c("n") == 1, c("owner_id")).when(c("n").isNull() & (c("tail_n") == 1), c("tail_id"))).where("owner_id is not null")
    held = told.join(claims.select("id", c("excerpt").alias("claimed")), "id").where(F.contains("claimed", "excerpt")).select("id", "start").distinct()
    return told.join(held, ["id", "start"], "left_anti").select("id", "chat_key", "owner_id", "start", "end", "words")
