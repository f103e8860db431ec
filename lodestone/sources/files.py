"""File sources: recursive listings with exclusions, text with its encoding, binary documents and image headers."""

from __future__ import annotations

import io
import json
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders of builds, caches and version control, which are never read.
PRUNED = ("Intermediate", "Binaries", "Saved", "DerivedDataCache", ".git", "node_modules")
#: The file of a project's settings, in its root.
CONFIG_FILE = "lodestone.json"


@dataclass(frozen=True)
class Config:
    """The settings of a project. `own` are the folders of the index and of this library within the project: what is read
    there would index itself."""

    exclude: tuple[str, ...] = ()
    shallow: tuple[str, ...] = ()
    docs_path: str = ""
    doc_types: dict[str, str] = field(default_factory=dict)
    external: tuple[tuple[str, str], ...] = ()
    registry: str = ""
    watch: bool = True
    own: tuple[str, ...] = (".lodestone", "Plugins/Lodestone")

    @classmethod
    def parse(cls, data: dict) -> Config:
        """Unknown and mistyped settings are ignored; shallow paths start with / and lose a trailing one."""
        texts = lambda key: tuple(x for x in data.get(key) or () if isinstance(x, str) and x)
        external = tuple((x["source"], x["path"]) for x in data.get("externalDocs") or () if isinstance(x, dict) and x.get("source") and x.get("path"))
        types = {k: v for k, v in (data.get("docTypes") or {}).items() if isinstance(v, str)}
        text = lambda key: data[key] if isinstance(data.get(key), str) else ""
        own = texts("own") or cls.own
        return cls(texts("exclude"), tuple(p.rstrip("/") for p in texts("shallowPaths") if p.startswith("/")), text("docsPath"), types, external, text("registry"), data.get("watch") is not False, own)

    @classmethod
    def read(cls, spark: SparkSession, root: str) -> Config:
        """The settings in the project's root; the defaults where there is no such file, or no JSON object in it."""
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{CONFIG_FILE}")
        if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            return cls()
        try:
            data = json.loads(spark.read.text(path.toString(), wholetext=True).first()[0])
        except (json.JSONDecodeError, TypeError):  # no JSON, or an empty file
            return cls()
        return cls.parse(data if isinstance(data, dict) else {})


def is_excluded(rel: Column, excludes: tuple[str, ...]) -> Column:
    """A folder of the path has an excluded name, or the path is an excluded one or lies below it."""
    folders = F.slice(F.split(rel, "/"), 1, F.size(F.split(rel, "/")) - 1)
    out = F.arrays_overlap(folders, F.array(*map(F.lit, (*PRUNED, *excludes))))
    for path in excludes:
        out = out | (rel == path) | rel.startswith(path.rstrip("/") + "/")
    return out


def is_shallow(package: Column, prefixes: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | (package == p) | package.startswith(p + "/")
    return out


def walk_files(spark: SparkSession, root: str, extensions: tuple[str, ...], config: Config | None = None) -> DataFrame:
    """rel, size, mtime, content of the files below root with one of the extensions (without dots, any case). The listing
    keeps these extensions only, so that no other file's content is read."""
    glob = ",".join("*." + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in e) for e in extensions)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"{{{glob}}}").load(root)
    base = re.escape(root.rstrip("/").removeprefix("file:").removeprefix("//"))
    rel = F.regexp_replace(F.col("path"), rf"^[a-z]*:?/*{base.lstrip('/')}/", "")
    out = files.select(rel.alias("rel"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    fitting = F.lower(F.regexp_extract("rel", r"\.([^./]+)$", 1)).isin(*[e.lower() for e in extensions])
    config = config or Config()
    return out.where(fitting & ~is_excluded(F.col("rel"), (*config.exclude, *config.own)))


def list_files(spark: SparkSession, root: str, extensions: tuple[str, ...], config: Config | None = None) -> DataFrame:
    """rel, sig (size and time) of the files that walk_files() would read; no content is read for it."""
    listed = walk_files(spark, root, extensions, config)
    return listed.select("rel", F.concat_ws("|", F.col("size").cast("string"), F.col("mtime").cast("string")).alias("sig"))


def some_files(spark: SparkSession, root: str, rels: list[str], config: Config | None = None) -> DataFrame:
    """rel, size, mtime, content of the files of these names only: others aren't opened. Names that are gone have no row."""
    base = root.rstrip("/")
    there = [p for p in (f"{base}/{r}" for r in rels) if _exists(spark, p)]
    if not there:
        return spark.createDataFrame([], "rel string, size long, mtime timestamp, content binary")
    plain = re.escape(base.removeprefix("file:").removeprefix("//"))
    files = spark.read.format("binaryFile").load(there)
    rel = F.regexp_replace(F.col("path"), rf"^[a-z]*:?/*{plain.lstrip('/')}/", "")
    return files.select(rel.alias("rel"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")


def _exists(spark: SparkSession, name: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def decode_text(content: Column) -> Column:
    """Text by its byte order mark (UTF-8, UTF-16), else as UTF-8."""
    head = F.hex(F.substring(content, 1, 3))
    return (
        F.when(head.startswith("EFBBBF"), F.decode(F.substr(content, F.lit(4)), "UTF-8"))
        .when(head.startswith("FFFE"), F.decode(F.substr(content, F.lit(3)), "UTF-16LE"))
        .when(head.startswith("FEFF"), F.decode(F.substr(content, F.lit(3)), "UTF-16BE"))
        .otherwise(F.decode(content, "UTF-8"))
    )


def docx_text(content: bytes) -> str:
    """Paragraphs of a Word document as lines; headings are marked as in Markdown. Unreadable files give the empty text."""
    try:
        xml = zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml").decode("utf-8", "replace")
    except (KeyError, zipfile.BadZipFile, zlib.error):
        return ""
    lines = []
    for body in re.findall(r"<w:p[ >].*?</w:p>", xml, re.S):
        text = "".join(unescape(t) if t else "\t" if tag == "tab" else "\n" for t, tag in re.findall(r"<w:t(?: [^>]*)?>([^<]*)</w:t>|<w:(tab|br)\b[^>]*/>", body))
        style = re.search(r'<w:pStyle w:val="(?:Heading([1-6])|(Title))"', body)
        lines.append("#" * int(style[1] or 1) + " " + text if style and text.strip() else text)
    return "\n".join(lines).strip()


_LIGATURES = str.maketrans({"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"})
MOST_STREAMS, MOST_INFLATED = 8000, 64 << 20


def _glyphs(table: str) -> tuple[dict[int, str], int]:
    """Glyph codes to text of a ToUnicode table, and the bytes of a code."""
    text = lambda h: bytes.fromhex(h if len(h) % 4 == 0 else h.zfill(4)).decode("utf-16-be", "replace")
    out, width = {}, 2
    if m := re.search(r"begincodespacerange\s*<([0-9a-fA-F]+)>", table):
        width = len(m[1]) // 2
    for block in re.findall(r"beginbfchar(.*?)endbfchar", table, re.S):
        out |= {int(a, 16): text(b) for a, b in re.findall(r"<([0-9a-fA-F]+)>\s*<([0-9a-fA-F]+)>", block)}
    for block in re.findall(r"beginbfrange(.*?)endbfrange", table, re.S):
        for a, b, c in re.findall(r"<([0-9a-fA-F]+)>\s*<([0-9a-fA-F]+)>\s*<([0-9a-fA-F]+)>", block):
            first = text(c)
            out |= {code: first[:-1] + chr(ord(first[-1]) + code - int(a, 16)) for code in range(int(a, 16), min(int(b, 16), int(a, 16) + 65535) + 1)}
    return out, width


def _pdf_streams(content: bytes) -> list[tuple[int, str, str]]:
    """Object number (0: unknown), dictionary and data of the readable streams."""
    out, total = [], 0
    for m in re.finditer(rb"(?:(\d+)\s+\d+\s+obj\s*)?(<<(?:(?!endobj)[^\x00]){0,2000}?>>)\s*stream\r?\n(.*?)\r?\nendstream", content, re.S):
        if len(out) >= MOST_STREAMS or total > MOST_INFLATED:
            break
        data = m[3]
        if b"FlateDecode" in m[2]:
            try:
                data = zlib.decompressobj().decompress(data, MOST_INFLATED - total + 1)
            except zlib.error:
                continue
        total += len(data)
        out.append((int(m[1] or 0), m[2].decode("latin-1"), data.decode("latin-1")))
    return out


def _pdf_objects(content: bytes, streams: list[tuple[int, str, str]]) -> dict[int, str]:
    """Object bodies by number, those in object streams among them."""
    plain = re.sub(rb"stream\r?\n.*?endstream", b"", content, flags=re.S).decode("latin-1")
    out = {int(n): body for n, body in re.findall(r"(\d+)\s+\d+\s+obj\b(.*?)endobj", plain, re.S)}
    for _, head, data in streams:
        first = re.search(r"/First\s+(\d+)", head)
        if "/ObjStm" in head and first:
            pairs = list(map(int, re.findall(r"\d+", data[: int(first[1])])))
            starts = [int(first[1]) + at for at in pairs[1::2]]
            out |= {n: data[at:end] for n, at, end in zip(pairs[::2], starts, [*starts[1:], len(data)])}
    return out


def _pdf_fonts(objects: dict[int, str], streams: list[tuple[int, str, str]]) -> tuple[dict[int, dict[str, int]], dict[str, int], dict[int, tuple[dict[int, str], int]]]:
    """Font objects by name for each content stream of a page, for streams without a page, and glyph tables by font object."""
    data = {n: text for n, _, text in streams if n}
    tables = {n: _glyphs(data[int(m[1])]) for n, body in objects.items() if (m := re.search(r"/ToUnicode\s+(\d+)\s+\d+\s+R", body)) and int(m[1]) in data}

    def named(body: str, depth: int = 0) -> dict[str, int]:
        """The fonts of a page or resource dictionary, or of the nodes above it."""
        fonts = re.search(r"/Font\s*<<(.*?)>>", body, re.S)
        if fonts:
            return {name: int(n) for name, n in re.findall(r"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", fonts[1])}
        for key in ("Font", "Resources", "Parent"):
            m = re.search(rf"/{key}\s+(\d+)\s+\d+\s+R", body)
            if m and depth < 16:
                other = objects.get(int(m[1]), "")
                found = named(f"/Font {other}" if key == "Font" else other, depth + 1)
                if found:
                    return found
        return {}

    by_stream: dict[int, dict[str, int]] = {}
    anywhere: dict[str, int] = {}
    for body in objects.values():
        m = re.search(r"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", body)
        if m:
            fonts = named(body)
            anywhere = {**fonts, **anywhere}
            by_stream |= {int(n): fonts for n in re.findall(r"(\d+)\s+\d+\s+R", m[1])}
    return by_stream, anywhere, tables


def pdf_text(content: bytes) -> str:
    """Text of a PDF: flate streams are inflated, glyph codes go through the ToUnicode table of the font in use (of all
    fonts where none is known), a line breaks where the text moves by more than 2 units up or down. Encrypted and
    unreadable files give the empty text."""
    streams = _pdf_streams(content)
    every = [_glyphs(text) for _, _, text in streams if "begincmap" in text]
    merged = ({k: v for t, _ in every for k, v in t.items()}, every[0][1] if every else 1)
    by_stream, anywhere, tables = _pdf_fonts(_pdf_objects(content, streams), streams) if every else ({}, {}, {})

    def shown(token: str, table: dict[int, str], width: int) -> str:
        if token.startswith("<"):
            digits = re.sub(r"\s", "", token[1:-1])
            raw = bytes.fromhex(digits + "0" * (len(digits) % 2))
        else:
            plain = re.sub(r"\\([0-7]{1,3})", lambda m: chr(int(m[1], 8) & 255), token[1:-1])
            raw = re.sub(r"\\(.)", lambda m: {"n": "\n", "r": "\r", "t": "\t"}.get(m[1], m[1]), plain, flags=re.S).encode("latin-1", "replace")
        if table:
            return "".join(table.get(int.from_bytes(raw[i : i + width], "big"), "" if width > 1 else chr(raw[i])) for i in range(0, len(raw), width))
        return raw.decode("latin-1")

    out: list[str] = []
    text = r"\((?:\\.|[^\\()])*\)|<[0-9a-fA-F\s]+>"
    token = re.compile(rf"({text})|\[((?:\((?:\\.|[^\\()])*\)|<[0-9a-fA-F\s]*>|[^\]])*)\]\s*TJ|(-?[\d.]+)\s+(-?[\d.]+)\s+T[dD]\b|(?:-?[\d.]+\s+){{4}}(-?[\d.]+)\s+(-?[\d.]+)\s+Tm\b|/(\S+)\s+[\d.]+\s+Tf\b|T\*", re.S)
    for number, _, stream in streams:
        if "BT" not in stream or "begincmap" in stream:
            continue
        fonts, current = by_stream.get(number) or anywhere, merged
        for body in re.findall(r"\bBT\b(.*?)\bET\b", stream, re.S):
            height = None
            for m in token.finditer(body):
                if m[1]:
                    out.append(shown(m[1], *current))
                elif m[2] is not None:
                    out.extend(shown(t, *current) for t in re.findall(text, m[2]))
                elif m[4] is not None:
                    out.append("\n" if abs(float(m[4])) > 2 else " ")
                elif m[6] is not None:
                    out.append("\n" if height is not None and abs(float(m[6]) - height) > 2 else "")
                    height = float(m[6])
                elif m[7] is not None:
                    font = fonts.get(m[7])
                    current = merged if font is None else tables.get(font, ({}, 1))
                else:
                    out.append("\n")
            out.append("\n")
    whole = "".join(out).translate(_LIGATURES)
    return re.sub(r"\n{3,}", "\n\n", re.sub(r" *\n *", "\n", re.sub(r"[ \t]+", " ", whole))).strip()


def image_size(content: bytes) -> tuple[str, int, int]:
    """Format, width and height by the header; zeros where it isn't known."""
    if content[:8] == b"\x89PNG\r\n\x1a\n" and len(content) >= 24:
        return "png", *struct.unpack(">II", content[16:24])
    if content[:6] in (b"GIF87a", b"GIF89a") and len(content) >= 10:
        return "gif", *struct.unpack("<HH", content[6:10])
    if content[:2] == b"BM" and len(content) >= 26:
        w, h = struct.unpack("<ii", content[18:26])
        return "bmp", w, abs(h)
    if content[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(content) and content[at] == 0xFF:
            kind, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                h, w = struct.unpack(">HH", content[at + 5 : at + 9])
                return "jpeg", w, h
            at += 2 + size
        return "jpeg", 0, 0
    return "", 0, 0


def with_text(files: DataFrame) -> DataFrame:
    """files (rel, content) with text: Word and PDF documents are read in Arrow batches, others are decoded in the JVM."""
    binary = F.lower("rel").rlike(r"\.(docx|pdf)$")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [docx_text(c) if r.lower().endswith("x") else pdf_text(c) for r, c in zip(batch["rel"], batch["content"])]
            yield pd.DataFrame({"rel": batch["rel"], "text": texts})

    plain = files.where(~binary).select("rel", decode_text(F.col("content")).alias("text"))
    return plain.unionByName(files.where(binary).select("rel", "content").mapInPandas(read, "rel string, text string"))


def with_image_size(files: DataFrame) -> DataFrame:
    """rel, format, width, height of images (rel, content); only the header's part of the content is sent to Python."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = [image_size(bytes(c)) for c in batch["head"]]
            yield pd.DataFrame({"rel": batch["rel"], "format": [s[0] for s in sizes], "width": [s[1] for s in sizes], "height": [s[2] for s in sizes]})

    return files.select("rel", F.substring("content", 1, 65536).alias("head")).mapInPandas(read, "rel string, format string, width int, height int")
