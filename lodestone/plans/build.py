"""Building an index from a project's files: every extractor's rows, ingested by producer, then linked."""

from __future__ import annotations

import hashlib
import json
import re
import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import aux_tokens, inner_type, reflection_name
from ..operators import code, intent, markup
from ..operators.lineage import settle
from ..operators.store import HISTORY, Snapshot, Store, diff_signatures, fingerprint, signatures_if_current, union_all
from ..schema import CHUNKS, EDGES, ENTITIES, edge, entity, validate
from ..sources import files
from ..sources.files import Config
from . import asset_build

DOCS, CODE, CONFIG, IMAGES, EXTERNAL, LINKS = "docs@1", "cpp@1", "config@1", "images@1", "docs-external@1", "doc-links@1"


def empty(spark: SparkSession) -> Snapshot:
    return Snapshot(spark.createDataFrame([], ENTITIES), spark.createDataFrame([], EDGES), spark.createDataFrame([], CHUNKS))


def _chunks(rows: DataFrame) -> DataFrame:
    """Chunks (id, entity_id, kind, text) with their auxiliary words."""
    return validate(rows.withColumn("aux", aux_tokens(F.col("entity_id"), F.col("text"))), "chunks")


DOC_TYPES = tuple(e for exts in markup.FORMATS.values() for e in exts)
CODE_TYPES, CONFIG_TYPES, IMAGE_TYPES, CAPTION_TYPES = ("h", "hpp", "cpp", "cc"), ("ini", "uproject", "uplugin"), ("png", "jpg", "jpeg", "gif", "bmp"), ("txt", "md")


def _read(spark: SparkSession, root: str, config: Config, extensions: tuple[str, ...], only: list[str] | None) -> DataFrame:
    """All files of these types, or only those of the given names, of which no other is opened."""
    return files.walk_files(spark, root, extensions, config) if only is None else files.some_files(spark, root, only, config)


def documents(spark: SparkSession, root: str, config: Config, source: str = "", only: list[str] | None = None) -> Snapshot:
    found = files.with_text(_read(spark, root, config, DOC_TYPES, only))
    entities, chunks = markup.document_rows(found, source, config.doc_types)
    return Snapshot(validate(entities, "entities"), empty(spark).edges, _chunks(chunks))


def external_documents(spark: SparkSession, config: Config) -> Snapshot:
    """Documents of all configured places; without any, an empty snapshot, so that removed places disappear."""
    parts = [documents(spark, path, config, source) for source, path in config.external]
    none = empty(spark)
    return Snapshot(union_all([none.entities, *(p.entities for p in parts)]), none.edges, union_all([none.chunks, *(p.chunks for p in parts)]))


def sources(spark: SparkSession, root: str, config: Config) -> Snapshot:
    """Classes, functions, properties, bodies, calls and bindings of C++ files."""
    found = files.walk_files(spark, root, CODE_TYPES, config).select(F.col("rel").alias("file"), files.decode_text(F.col("content")).alias("text"))
    headers, bodies_in = found.where(F.col("file").rlike(r"\.h(pp)?$")), found.where(~F.col("file").rlike(r"\.h(pp)?$"))
    declared = code.classes(headers).withColumn("class", reflection_name(F.col("name")))
    # The names of the project's own classes: as many as it has reflected classes.
    known = [r["name"] for r in declared.select("name").distinct().collect()]
    defined = code.bodies(bodies_in, known)
    id = F.concat(F.lit("cpp:"), F.col("class"))
    kind = F.when(F.col("macro") == "USTRUCT", "cpp-struct").otherwise("cpp-class")
    tops = declared.select(*entity(id, "cpp-class", F.col("class"), F.col("file"), "cpp", summary=F.concat_ws(" ", F.lit("Declared in"), "file")), kind.alias("k")).withColumn("kind", F.col("k")).drop("k")
    named = declared.select("class", "file", F.explode("functions").alias("f")).unionByName(defined.select(reflection_name(F.col("class")).alias("class"), "file", F.col("function").alias("f")))
    named = named.groupBy("class", "f").agg(F.min("file").alias("file"))
    member = F.concat(F.lit("cpp:"), F.col("class"), F.lit("::"), F.col("f"))
    functions = named.select(*entity(member, "cpp-function", F.col("f"), F.col("file"), "cpp", id))
    typed = declared.select("class", "file", F.explode("properties").alias("p")).select("class", "file", F.substring_index("p", ":", 1).alias("f"), F.expr("substring(p, instr(p, ':') + 1)").alias("type"))
    properties = typed.select(*entity(member, "cpp-property", F.col("f"), F.col("file"), "cpp", id, detail=F.to_json(F.struct("type"))))
    bases = declared.where("base <> ''").select(*edge(id, F.concat(F.lit("cpp:"), reflection_name(F.col("base"))), "inherits"))
    uses = typed.join(declared.select(F.col("class").alias("held")).distinct(), reflection_name(inner_type(F.col("type"))) == F.col("held"))
    held = uses.select(*edge(id, F.concat(F.lit("cpp:"), F.col("held")), "references", F.col("f")))
    called = code.calls(defined, declared.drop("class")).select(*edge(F.concat(F.lit("cpp:"), F.col("src")), F.concat(F.lit("cpp:"), F.col("dst")), "calls"))
    bound = code.bindings(bodies_in).withColumn("class", reflection_name(F.col("class"))).select(*edge(F.concat(F.lit("cpp:"), F.col("class"), F.lit("::"), F.col("handler")), F.concat(F.lit("cpp:"), F.col("class"), F.lit("::"), F.col("property")), "binds-input", F.col("trigger")))
    signatures = declared.select(F.concat(F.lit("sig:"), id).alias("id"), id.alias("entity_id"), F.lit("cpp-signature").alias("kind"), F.concat_ws(" ", "macro", "name", F.lit(":"), "base", F.array_join("functions", " "), F.array_join("properties", " ")).alias("text"))
    texts = defined.groupBy(reflection_name(F.col("class")).alias("class"), F.col("function").alias("f")).agg(F.min(F.concat_ws(" ", F.concat_ws("::", "class", "function"), F.concat(F.lit("("), F.col("params"), F.lit(")")), F.left("body", F.lit(code.MOST_BODY)))).alias("text"))
    bodies = texts.select(F.concat(F.lit("body:"), member).alias("id"), member.alias("entity_id"), F.lit("cpp-body").alias("kind"), "text")
    edges = union_all([bases, held, called, bound]).dropDuplicates(["src", "dst", "type"])
    entities = union_all([tops, functions, properties]).dropDuplicates(["id"])
    return Snapshot(validate(entities, "entities"), validate(edges, "edges"), _chunks(signatures.unionByName(bodies).dropDuplicates(["id"])))


def configuration(spark: SparkSession, root: str, config: Config) -> Snapshot:
    """Sections of ini files and plugins of project manifests."""
    found = files.walk_files(spark, root, CONFIG_TYPES, config).where(~markup.is_stale_config(F.col("rel"))).select("rel", files.decode_text(F.col("content")).alias("text"))
    keys = markup.parse_ini(found.where(F.lower("rel").endswith(".ini")))
    sections = keys.groupBy("rel", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", F.concat_ws("=", "key", "value").alias("x")))), lambda v: v["x"]), "\n").alias("text"), F.array_sort(F.collect_set("key")).alias("keys"))
    id = F.concat(F.lit("config:"), F.col("rel"), F.lit("#"), F.col("section"))
    rows = sections.select(*entity(id, "config-section", F.col("section"), F.col("rel"), "config", detail=F.to_json(F.struct("keys"))))
    plugins = markup.plugins(found.where(~F.lower("rel").endswith(".ini"))).groupBy("plugin").agg(F.min("rel").alias("rel"), F.max("enabled").alias("enabled"))
    plugin = F.concat(F.lit("plugin:"), F.col("plugin"))
    rows = rows.unionByName(plugins.select(*entity(plugin, "plugin", F.col("plugin"), F.col("rel"), "config", detail=F.to_json(F.struct("enabled")))))
    chunks = sections.select(F.concat(F.lit("block:"), id).alias("id"), id.alias("entity_id"), F.lit("config-block").alias("kind"), F.concat_ws("\n", F.concat(F.lit("["), F.col("section"), F.lit("]")), "text").alias("text"))
    chunks = chunks.unionByName(plugins.select(F.concat(F.lit("block:"), plugin).alias("id"), plugin.alias("entity_id"), F.lit("config-block").alias("kind"), F.concat_ws(" ", F.lit("Plugin"), "plugin", F.when(F.col("enabled"), "enabled").otherwise("disabled")).alias("text")))
    return Snapshot(validate(rows, "entities"), empty(spark).edges, _chunks(chunks))


_STEM = r"\.[^./]+$"


def images(spark: SparkSession, root: str, config: Config, only: list[str] | None = None) -> Snapshot:
    """Images below the usual folders, with their sizes, tags and captions (a text of the same name beside them)."""
    found = _read(spark, root, config, IMAGE_TYPES, only).where(markup.under_image_root(F.col("rel")))
    beside = None if only is None else [f"{re.sub(_STEM, '', rel)}.{e}" for rel in only for e in CAPTION_TYPES]
    sizes = files.with_image_size(found)
    stem = F.regexp_replace("rel", _STEM, "")
    captions = _read(spark, root, config, CAPTION_TYPES, beside).select(stem.alias("stem"), markup.caption(files.decode_text(F.col("content"))).alias("caption")).dropDuplicates(["stem"])
    rows = sizes.withColumn("stem", stem).join(captions, "stem", "left").withColumn("tags", markup.image_tags(F.col("rel")))
    id = F.concat(F.lit("image:"), F.col("rel"))
    entities = rows.select(*entity(id, "image", F.element_at(F.split("rel", "/"), -1), F.col("rel"), "image", detail=F.to_json(F.struct("format", "width", "height", "tags"))))
    chunks = rows.select(F.concat(F.lit("chunk:"), id).alias("id"), id.alias("entity_id"), F.lit("image").alias("kind"), F.concat_ws(" ", F.lit("Image"), "rel", F.concat_ws("x", F.col("width").cast("string"), F.col("height").cast("string")), F.array_join("tags", " "), "caption").alias("text"))
    return Snapshot(validate(entities, "entities"), empty(spark).edges, _chunks(chunks))


def links(spark: SparkSession, state: Snapshot) -> Snapshot:
    none = empty(spark)
    return Snapshot(none.entities, validate(intent.build_links(state.entities, state.chunks), "edges"), none.chunks)


def list_documents(spark: SparkSession, root: str, config: Config) -> DataFrame:
    return files.list_files(spark, root, DOC_TYPES, config)


def list_images(spark: SparkSession, root: str, config: Config) -> DataFrame:
    """Images with a signature that also tells of their captions."""
    stem = F.regexp_replace("rel", _STEM, "").alias("stem")
    own = files.list_files(spark, root, IMAGE_TYPES, config).where(markup.under_image_root(F.col("rel")))
    captions = files.list_files(spark, root, CAPTION_TYPES, config).groupBy(stem).agg(F.array_join(F.array_sort(F.collect_list("sig")), ";").alias("beside"))
    return own.withColumn("stem", stem).join(captions, "stem", "left").select("rel", F.concat_ws(";", "sig", "beside").alias("sig"))


STAGES = {DOCS: documents, CODE: sources, CONFIG: configuration, IMAGES: images}
#: Stages whose files don't depend on each other, with their listings: they read the files that have changed. The others
#: (calls between sources, keys over several files) read all of theirs.
PER_FILE = {DOCS: list_documents, IMAGES: list_images}
ASSET_STAGES = (asset_build.REGISTRY, asset_build.ASSETS, asset_build.SCRIPTS)
SIGNATURES = "producer string, id string, sig string, generation string"
#: More changed files than these are read with all others of their stage.
MOST_CHANGED = 10_000
#: Another number makes all builds read everything again: it goes up when extractors make other rows of the same files.
EXTRACTORS = 3
#: A build that began longer ago than this, in seconds, no longer holds up a check of the sources.
LONGEST_BUILD = 6 * 3600


@dataclass
class Result:
    ok: bool
    counts: dict[str, int]
    seconds: dict[str, float]
    #: How many files or assets each stage has read, where it knows.
    read: dict[str, int] = field(default_factory=dict)


#: Extensions of the files that any stage reads.
SOURCES = (*DOC_TYPES, *CODE_TYPES, *CONFIG_TYPES, *IMAGE_TYPES, "txt")


def sources_fingerprint(spark: SparkSession, root: str, config: Config) -> str:
    """Of paths, sizes and times of all source files, external ones and the registry's among them, and of the settings and
    the extractors; no content is read."""
    roots = [root, *(path for _, path in config.external)]
    listed = [files.walk_files(spark, r, SOURCES, config).select(F.concat(F.lit(f"{i}:"), "rel").alias("path"), "size", F.col("mtime").cast("string").alias("mtime")) for i, r in enumerate(roots)]
    if config.registry:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(config.registry)
        listed.append(found.select(F.concat(F.lit("registry:"), "path").alias("path"), F.col("length").alias("size"), F.col("modificationTime").cast("string").alias("mtime")))
    return f"{fingerprint(union_all(listed), 64).first()[0]}/{EXTRACTORS}/{config!r}"


def code_fingerprint(spark: SparkSession, root: str, config: Config) -> str:
    """As sources_fingerprint(), of the sources in C++ only."""
    listed = files.walk_files(spark, root, CODE_TYPES, config).select(F.col("rel").alias("path"), "size", F.col("mtime").cast("string").alias("mtime"))
    return f"{fingerprint(listed, 64).first()[0]}/{EXTRACTORS}/{(config.exclude, config.own)!r}"


class Changes:
    """What a stage has to read: its listing (id, sig) against the signatures that the store keeps of the last good run.

    The comparison comes before any content is read. Signatures of another generation of the store are void, and so are
    those made with other settings or other extractors."""

    def __init__(self, store: Store, producer: str, listed: DataFrame, config: Config):
        self.producer, self.generation = producer, store.generation
        stamp = hashlib.md5(f"{EXTRACTORS}{config!r}".encode()).hexdigest()
        self.listed = settle(listed.select("id", F.when(F.col("sig") == "", "").otherwise(F.concat(F.lit(f"{stamp}|"), "sig")).alias("sig")))
        held = signatures_if_current(store.side("signatures", SIGNATURES), self.generation).where(F.col("producer") == producer)
        self.first = held.isEmpty()
        self.diff = settle(diff_signatures(held.select("id", "sig"), self.listed).where("change <> 'same'"))
        self.ids = self.diff.select("id")

    def names(self) -> list[str] | None:
        """The changed and added ids; None if all have to be read: at first, or if they are more than MOST_CHANGED."""
        if self.first:
            return None
        found = [r["id"] for r in self.diff.where("change <> 'removed'").limit(MOST_CHANGED + 1).collect()]
        return None if len(found) > MOST_CHANGED else found

    def keep(self, store: Store) -> None:
        """The listing as the signatures of this producer; those of others stay."""
        others = store.side("signatures", SIGNATURES).where(F.col("producer") != self.producer)
        mine = self.listed.select(F.lit(self.producer).alias("producer"), "id", "sig", F.lit(self.generation).alias("generation"))
        store.put_side("signatures", others.unionByName(mine))


def _per_file(spark: SparkSession, root: str, config: Config, store: Store, producer: str, full: bool) -> int:
    """Brings a producer up to date by the files that have changed; how many were read."""
    listing = PER_FILE[producer](spark, root, config).select(F.col("rel").alias("id"), "sig")
    changes = Changes(store, producer, listing, config)
    names = None if full else changes.names()
    if names is None:
        store.ingest(producer, STAGES[producer](spark, root, config))
        read = changes.listed.count()
    elif changes.diff.isEmpty():
        return 0
    else:
        state = store.open()
        own = state.entities.where((F.col("producer") == producer) & F.col("parent").isNull())
        roots = own.join(changes.ids.select(F.col("id").alias("path")), "path", "left_semi").select("id")
        store.ingest(producer, STAGES[producer](spark, root, config, only=names), "delta", roots)
        read = len(names)
    changes.keep(store)
    return read


def _assets(spark: SparkSession, config: Config, store: Store, full: bool) -> int:
    """Brings the asset producers up to date by the assets whose signature has changed; how many were read."""
    table = asset_build.read_registry(spark, config.registry)
    changes = Changes(store, asset_build.ASSETS, asset_build.signatures(table), config)
    if full or changes.first:
        for producer, rows in asset_build.snapshots(table, config.shallow).items():
            store.ingest(producer, rows)
        read = changes.listed.count()
    else:
        some = settle(table.join(changes.diff.where("change <> 'removed'").select(F.col("id").alias("package")), "package", "left_semi").select(*table.columns))
        read = some.count()
        if changes.diff.isEmpty():
            return 0
        roots = changes.ids.select(F.concat(F.lit("asset:"), "id").alias("id"))
        for producer, rows in asset_build.snapshots(some, config.shallow).items():
            store.ingest(producer, rows, "delta", roots)
    changes.keep(store)
    return read


def build(spark: SparkSession, root: str, store: Store, config: Config | None = None, only: tuple[str, ...] = (), full: bool = False) -> Result:
    """Extract (all producers, or `only` some), ingest each producer's rows, link, verify and note the run.

    Without `config` the settings are read from the project. Where the sources' fingerprint, the settings and the
    extractors are those of the last good run, nothing is done, unless `full`; stages that can read single files or assets
    read the changed ones. Stages are independent; one that fails leaves its producer's old rows and fails the run."""
    config, failed = config or Config.read(spark, root), []
    seconds: dict[str, float] = {}
    read: dict[str, int] = {}
    store.create()
    store.heal()
    try:
        now = sources_fingerprint(spark, root, config)
    except Exception:  # noqa: BLE001  a place that can't be listed: its stage will say so
        now = ""
    held = store.meta()
    if now and not full and not only and held.get("fingerprint") == now and json.loads(held.get("lastResult", "{}")).get("ok"):
        return Result(True, store.verify(), {})
    store.note(building=str(int(time.time())))
    whole = {CODE: lambda: sources(spark, root, config), CONFIG: lambda: configuration(spark, root, config), EXTERNAL: lambda: external_documents(spark, config)}
    stages = {
        **{p: lambda p=p: read.update({p: _per_file(spark, root, config, store, p, full)}) for p in PER_FILE},
        **{p: lambda p=p, f=f: store.ingest(p, f()) for p, f in whole.items()},
    }
    if config.registry:
        stages[asset_build.ASSETS] = lambda: read.update({asset_build.ASSETS: _assets(spark, config, store, full)})
    notes = {}
    for producer, stage in stages.items():
        if only and producer not in only:
            continue
        began = time.time()
        try:
            notes |= {"codeFingerprint": code_fingerprint(spark, root, config)} if producer == CODE else {}
            stage()
        except Exception as error:  # noqa: BLE001  the run is reported as failed, with the stage
            failed.append(f"{producer}: {error}"[:200])
            notes |= {"codeFingerprint": ""} if producer == CODE else {}
        seconds[producer] = round(time.time() - began, 3)
    store.ingest(LINKS, links(spark, store.open()))
    counts = store.verify()
    result = Result(not failed, counts, seconds, read)
    notes |= {"fingerprint": now} if now and result.ok and not only else {}
    note_run(store, result, failed, "+".join(only) or "full", building="", **notes)
    return result


def note_run(store: Store, result: Result, failed: list[str], kind: str = "full", **notes: str) -> None:
    """Keep the newest runs and the last result beside the index."""
    now = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
    runs = [*json.loads(store.meta().get("runs", "[]")), {"at": now, "seconds": result.seconds, "ok": result.ok}][-HISTORY:]
    last = {"at": now, "time": time.time(), "kind": kind, "ok": result.ok, "seconds": round(sum(result.seconds.values()), 3), "counts": result.counts, "failed": failed}
    store.note(runs=json.dumps(runs), lastResult=json.dumps(last), **notes)


def last_result(store: Store, since: float = 0.0) -> dict | None:
    """What the last build noted as its last act, if that was at or after `since` (seconds of the epoch): who starts a build
    as another process judges it by this, and not by what an earlier one has left."""
    last = json.loads(store.meta().get("lastResult", "{}"))
    return last if last and last.get("time", 0.0) >= since else None


def check_sources(spark: SparkSession, root: str, store: Store, config: Config | None = None) -> Result | None:
    """Runs the code stage, and no other, if the fingerprint of the C++ sources isn't the noted one. Nothing is done where
    watching is switched off, there is no index, code was never extracted, or a build is running."""
    config, meta = config or Config.read(spark, root), store.meta()
    began = float(meta.get("building") or 0)
    if not config.watch or "codeFingerprint" not in meta or time.time() - began < LONGEST_BUILD:
        return None
    if meta.get("codeFingerprint") == code_fingerprint(spark, root, config):
        return None
    return build(spark, root, store, config, only=(CODE,))


def watch_sources(spark: SparkSession, root: str, store: Store, checkpoint: str, config: Config | None = None, every: str = "5 minutes") -> StreamingQuery:
    """A stream whose batches are the ticks of a clock: each checks the sources. A batch that was lost is made up for by the
    next, since the check looks at the files and not at the batch."""

    def tick(_: DataFrame, number: int) -> None:
        check_sources(spark, root, store, config)

    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(tick).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
