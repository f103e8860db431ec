"""C++ headers and sources: reflected classes, bodies, input bindings and calls."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import inner_type, reflection_name
from .graph import ancestors

MOST_BODY = 2400
# Words that stand before a parenthesis without being a call.
NOT_CALLS = {"if", "for", "while", "switch", "return", "sizeof", "catch", "new", "delete", "else", "do", "static_cast", "const_cast", "dynamic_cast", "reinterpret_cast", "decltype", "alignof"}


def blank_comments(code: str) -> str:
    """The code with comments and literals as spaces; its length and line feeds stay."""
    found = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"?|\'(?:\\.|[^\'\\\n])+\'', re.S)
    return found.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), code)


def closing(code: str, at: int) -> int:
    """Place of the bracket that closes the one at `at`, or -1; the code has no literals."""
    pair = {"(": ")", "{": "}", "[": "]"}[code[at]]
    depth = 0
    for m in re.compile(re.escape(code[at]) + "|" + re.escape(pair)).finditer(code, at):
        depth += 1 if m[0] == code[at] else -1
        if not depth:
            return m.start()
    return -1


def parse_header(text: str) -> list[dict]:
    """Reflected classes and structs of a header: macro, name, base, functions, properties (name and type)."""
    bare, out = blank_comments(text), []
    for macro in re.finditer(r"\bU(CLASS|STRUCT|INTERFACE)\s*\(", bare):
        end = closing(bare, macro.end() - 1)
        declared = re.compile(r"\s*(?:class|struct)\s+(?:[A-Z0-9_]+_API\s+)?([A-Za-z_]\w*)(?:\s+final)?(?:\s*:\s*public\s+([A-Za-z_]\w*))?").match(bare, end + 1) if end > 0 else None
        brace = bare.find("{", declared.end()) if declared else -1
        if brace < 0 or ";" in bare[declared.end() : brace]:
            continue
        body = bare[brace : closing(bare, brace) + 1 or len(bare)]
        functions, properties = [], []
        for m in re.finditer(r"\bU(FUNCTION|PROPERTY)\s*\(", body):
            after = closing(body, m.end() - 1)
            if after < 0:
                continue
            if m[1] == "FUNCTION":
                named = re.compile(r"[^;{}]*?\b([A-Za-z_]\w*)\s*\(").match(body, after + 1)
                functions += [named[1]] if named else []
            else:
                named = re.compile(r"\s*([A-Za-z_][\w:<>,\s*&]*?)\b([A-Za-z_]\w*)\s*(?:;|=|\{|\[)").match(body, after + 1)
                properties += [(named[2], " ".join(named[1].split()))] if named and named[1].strip() else []
        out.append({"macro": "U" + macro[1], "name": declared[1], "base": declared[2] or "", "functions": list(dict.fromkeys(functions)), "properties": [f"{n}:{t}" for n, t in properties]})
    return out


def parse_bodies(text: str, known: set[str]) -> tuple[list[dict], list[dict]]:
    """Definitions Class::Function(params) {...} of known classes, and the actions that they bind."""
    bare, bodies, bindings = blank_comments(text), [], []
    for m in re.finditer(r"\b([A-Za-z_]\w*)\s*::\s*(~?[A-Za-z_]\w*)\s*\(", bare):
        if m[1] not in known:
            continue
        close = closing(bare, m.end() - 1)
        tail = re.compile(r"\s*(?:(?:const|noexcept|override|final)\b\s*)*").match(bare, close + 1).end() if close > 0 else -1
        if close > 0 and bare[tail : tail + 1] == ":" and bare[tail : tail + 2] != "::":  # initialisers of a constructor
            at = tail + 1
            while step := re.compile(r"\s*[A-Za-z_][\w:<>]*\s*([({])").match(bare, at):
                end = closing(bare, step.end() - 1)
                comma = re.compile(r"\s*(,?)").match(bare, end + 1)
                at = comma.end()
                if end < 0 or not comma[1]:
                    break
            tail = re.compile(r"\s*").match(bare, at).end()
            if m[2] not in (m[1], "~" + m[1]):
                continue
        if close < 0 or bare[tail : tail + 1] != "{":
            continue
        end = closing(bare, tail)
        whole = text[tail : end + 1 if end > 0 else len(text)]
        bodies.append({"class": m[1], "function": m[2], "params": " ".join(text[m.end() : close].split()), "body": whole})
    for m in re.finditer(r"\bBindAction\s*\(\s*([A-Za-z_]\w*)\s*,\s*(?:ETriggerEvent\s*::\s*)?([A-Za-z_]\w*)\s*,\s*[^,()]+,\s*&\s*([A-Za-z_]\w*)\s*::\s*([A-Za-z_]\w*)", bare):
        bindings.append({"property": m[1], "trigger": m[2], "class": m[3], "handler": m[4]})
    return bodies, bindings


def call_sites(body: str) -> list[tuple[str, str, str]]:
    """Calls in a body as (shape, receiver, function): bare, super, own (this->), qualified (Class::) and member (name->)."""
    bare, out = blank_comments(body), []
    for m in re.finditer(r"(?:(\)|\]|\b[A-Za-z_]\w*)\s*(->|\.|::)\s*)?\b([A-Za-z_]\w*)\s*\(", bare):
        receiver, link, name = m[1], m[2], m[3]
        if name in NOT_CALLS:
            continue
        before = bare[: m.start()].rstrip()
        chained = before.endswith(("->", ".", "::")) and not (link is None and False)
        if link is None:
            if not chained:
                out.append(("bare", "", name))
        elif receiver in (")", "]") or chained:
            continue
        elif link == "::":
            out.append(("super", "", name) if receiver == "Super" else ("qualified", receiver, name))
        elif link == "->" or link == ".":
            out.append(("own", "", name) if receiver == "this" else ("member", receiver, name))
    return list(dict.fromkeys(out))


def _parsed(files: DataFrame, function, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{"file": f, **row} for f, text in zip(batch["file"], batch["text"]) for row in function(text or "")]
            yield pd.DataFrame(rows, columns=[part.split()[0] for part in re.split(r", (?=\w+ )", schema)])

    return files.select("file", "text").mapInPandas(run, schema)


def classes(headers: DataFrame) -> DataFrame:
    """file, macro, name, base, functions, properties (name:type) of headers (file, text)."""
    return _parsed(headers, parse_header, "file string, macro string, name string, base string, functions array<string>, properties array<string>")


def bodies(sources: DataFrame, known: list[str]) -> DataFrame:
    """file, class, function, params, body of sources (file, text). `known` names the project's classes."""
    names = set(known)
    return _parsed(sources, lambda t: parse_bodies(t, names)[0], "file string, class string, function string, params string, body string")


def bindings(sources: DataFrame) -> DataFrame:
    return _parsed(sources, lambda t: parse_bodies(t, set())[1], "file string, property string, trigger string, class string, handler string").dropDuplicates(["property", "trigger", "class", "handler"])


def calls(defined: DataFrame, declared: DataFrame) -> DataFrame:
    """src and dst (Class::Function) of the calls in `defined` (bodies()) that resolve in `declared` (classes()).

    Call sites come from the text; the receiver's class from the shape, from the properties of the class and its bases, or
    from the parameters; the function from the nearest class of the chain that declares it. Calls of oneself and of
    unknown receivers go."""
    sites = defined.select(reflection_name(F.col("class")).alias("owner"), "function", "params", "body")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(o, f, p, *site) for o, f, p, b in batch[["owner", "function", "params", "body"]].itertuples(index=False) for site in call_sites(b)]
            yield pd.DataFrame(rows, columns=["owner", "function", "params", "shape", "receiver", "callee"])

    found = sites.mapInPandas(run, "owner string, function string, params string, shape string, receiver string, callee string").distinct()
    own = declared.select(reflection_name(F.col("name")).alias("class"), reflection_name(F.col("base")).alias("base"), "functions", "properties")
    chain = ancestors(own.select(F.col("class").alias("node"), "base"))
    alone = own.select(F.col("class").alias("node"), F.col("class").alias("ancestor"), F.lit(0).alias("hops"))
    chain = chain.unionByName(alone).distinct()
    functions = own.select(F.col("class").alias("ancestor"), F.explode(F.concat("functions")).alias("callee")).distinct()
    types = own.select(F.col("class").alias("ancestor"), F.explode("properties").alias("p")).select("ancestor", F.substring_index("p", ":", 1).alias("receiver"), reflection_name(inner_type(F.substring(F.col("p"), F.instr("p", ":") + 1, F.length("p")))).alias("type"))
    held = chain.join(types, "ancestor").groupBy(F.col("node").alias("owner"), "receiver").agg(F.min_by("type", "hops").alias("held"))

    pieces = F.transform(F.split(F.regexp_replace("params", r"=[^,]*", ""), r",(?![^<]*>)"), lambda x: F.struct(F.regexp_extract(x, r"([A-Za-z_]\w*)\s*$", 1).alias("n"), reflection_name(inner_type(F.trim(F.regexp_replace(x, r"[A-Za-z_]\w*\s*$", "")))).alias("t")))
    passed = F.element_at(F.transform(F.filter(pieces, lambda x: x["n"] == F.col("receiver")), lambda x: x["t"]), 1)
    typed = found.join(held, ["owner", "receiver"], "left").withColumn("passed", F.when(F.size(F.filter(pieces, lambda x: x["n"] == F.col("receiver"))) > 0, passed))
    start = F.when(F.col("shape") == "qualified", reflection_name(F.col("receiver"))).when(F.col("shape") == "member", F.coalesce("held", "passed")).otherwise(F.col("owner"))
    resolved = typed.withColumn("node", start).join(chain, "node").where((F.col("shape") != "super") | (F.col("hops") > 0)).join(functions, ["ancestor", "callee"])
    nearest = F.row_number().over(Window.partitionBy("owner", "function", "shape", "receiver", "callee").orderBy("hops", "ancestor"))
    out = resolved.withColumn("place", nearest).where("place = 1").select(F.concat_ws("::", "owner", "function").alias("src"), F.concat_ws("::", "ancestor", "callee").alias("dst"))
    return out.where("src <> dst").distinct()
