"""Substring dedup over a log-structured fingerprint index.

A window is ``WINDOW`` consecutive words.  Its fingerprint is the smallest hash of the ``ANCHOR``-word runs inside it, so
equal windows have equal fingerprints, while neighbouring windows mostly share one: a text has about
2 / (WINDOW - ANCHOR + 2) fingerprints a word.  The index is a folder of immutable runs, bucketed and sorted by their key, which a
manifest lists:

* ``digests``: the smallest document of each whole text, so exact copies are told at once and enter no other run;
* ``fps``: the smallest document of each fingerprint, and whether several documents have it;
* ``windows``: the smallest document of each window (128-bit digest of its words), for windows whose fingerprint is shared;
* ``texts``: the log of the documents' texts, by id, from which windows are taken when a later batch shares their fingerprint;
* ``marks``: the places of the windows that start in a smaller document, by document.

A batch is merge-joined with the runs, which are neither shuffled nor sorted again, and adds runs of its own; at ``FAN_IN`` runs of a
kind the next batch first compacts two of them into one.  Fingerprints only choose candidates; the verdict is over digests of the candidates' words.
"""

from __future__ import annotations

import json
import uuid
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from .store import Workspace, small_batches

WINDOW, ANCHOR, FAN_IN, BATCHES = 13, 5, 3, 4
GOLD, MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
#: Parts that the rows of one whole text are divided into where they meet its smallest document.
SALTS = 16
#: Columns of each kind of run, and how many of the first are its key.
KINDS = {
    "digests": ("digest binary, first long, last long", 1),
    "fps": ("fp long, first long, several boolean, promoted long", 1),
    "windows": ("wa long, wb long, first long, last long", 2),
    "texts": ("doc_id long, text string, copy boolean, tag long", 1),
    "marks": ("doc_id long, places array<long>", 1),
}


def _word_hashes(words: list[bytes]):
    import numpy as np
    from xxhash import xxh3_64_intdigest

    return np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words))


def _runs_of(words, n: int):
    """The hash of every run of n words (numpy, uint64)."""
    import numpy as np

    count = max(0, len(words) - n + 1)
    total = np.full(count, n, np.uint64)
    for i in range(n):
        total = (total ^ (total >> np.uint64(29))) * np.uint64(GOLD) + words[i : i + count]
    total ^= total >> np.uint64(32)
    total *= np.uint64(MIX)
    return total ^ (total >> np.uint64(32))


def fingerprints(words, window: int = WINDOW, anchor: int = ANCHOR):
    """The fingerprint of every window (numpy, int64), from word hashes; none where there are fewer words."""
    import numpy as np

    count = len(words) - window + 1
    if count < 1:
        return np.zeros(0, np.int64)
    runs, span, held = _runs_of(words, anchor), window - anchor + 1, 1
    while 2 * held <= span:
        runs = np.minimum(runs[: len(runs) - held], runs[held:])
        held *= 2
    return np.minimum(runs[:count], runs[span - held : span - held + count]).view(np.int64)


@contextmanager
def _sorted_scans(spark: SparkSession):
    """Scans of runs promise their order while a step is planned and run, so merge joins don't sort runs again; the session's
    setting is put back."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class FingerprintIndex:
    """The index in a shared folder; ``open`` finds what earlier calls have committed, in this session or another.

    A batch's runs count from the moment its manifest is renamed into place: a call that dies before leaves files that no manifest
    lists, and can be repeated.
    """

    def __init__(self, work: Workspace, fan_in: int = FAN_IN):
        self.work, self.spark, self.fan_in, self.version = work, work.spark, fan_in, 0
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.runs: dict[str, list[str]] = {kind: [] for kind in KINDS}
        self._tables: dict[str, str] = {}

    @classmethod
    def open(cls, spark: SparkSession, root: str, fan_in: int = FAN_IN) -> FingerprintIndex:
        """The index of that folder, empty if there is none yet."""
        work = Workspace(spark, "index", root)
        index = cls(work, fan_in)
        if versions := sorted(x for x in work.names() if x.startswith("manifest-")):
            found = json.loads(spark.read.text(work.path(versions[-1]), wholetext=True).first()[0])
            index.version, index.buckets, index.runs = found["version"], found["buckets"], found["runs"]
        return index

    def _commit(self) -> None:
        self.version += 1
        self.work.put(f"manifest-{self.version:08d}", json.dumps({"version": self.version, "buckets": self.buckets, "runs": self.runs}))

    def _table(self, name: str) -> DataFrame:
        """A run as a bucketed table, which the session's catalog gets to know if it doesn't yet."""
        if name not in self._tables:
            columns, keys = KINDS[name.split("-")[0]]
            by = [c.split()[0] for c in columns.split(", ")][:keys]
            table = f"gradus_{uuid.uuid4().hex}"
            typed = columns.replace(" long", " bigint")
            self.spark.sql(f"CREATE TABLE {table} ({typed}) USING parquet CLUSTERED BY ({', '.join(by)}) SORTED BY ({', '.join(by)}) INTO {self.buckets} BUCKETS LOCATION '{self.work.path(name)}'")
            self._tables[name] = table
        return self.spark.table(self._tables[name])

    def _plain(self, name: str) -> DataFrame:
        """A run as files: joins with it shuffle both sides, so Spark can divide hot keys."""
        return self.spark.read.schema(KINDS[name.split("-")[0]][0]).parquet(self.work.path(name))

    def _store(self, kind: str, df: DataFrame, merged: bool = False) -> str:
        """Writes a run; ``merged`` rows come from a merge join of runs, so each task holds a bucket already."""
        columns, keys = KINDS[kind]
        names = [c.split()[0] for c in columns.split(", ")]
        name, table = f"{kind}-{uuid.uuid4().hex}", f"gradus_{uuid.uuid4().hex}"
        key = names[:keys]
        dealt = df.select(*names) if merged else df.select(*names).repartition(self.buckets, *key).sortWithinPartitions(*key)
        with _sorted_scans(self.spark):
            dealt.write.bucketBy(self.buckets, *key).sortBy(*key).option("path", self.work.path(name)).saveAsTable(table)
        self._tables[name] = table
        return name

    def _known(self, new: DataFrame, kind: str, on: list[str], columns: list[str]) -> tuple[DataFrame, dict[str, list]]:
        """``new`` merge-joined with every run of the kind; the runs' columns by name, each null where a run lacks the key."""
        found: dict[str, list] = {c: [] for c in columns}
        for i, name in enumerate(self.runs[kind]):
            old = self._table(name).select(*on, *[F.col(c).alias(f"{c}_{i}") for c in columns])
            new = new.join(old.hint("merge"), on, "left")
            for c in columns:
                found[c].append(F.col(f"{c}_{i}"))
        return new, found

    def absorb(self, batch: DataFrame) -> DataFrame:
        """Adds a batch (doc_id, text) of no null ids and returns its verdict: doc_id, text, copy, tag, places.

        ``copy`` says that a smaller document, of this batch or an earlier one, has the same text; ``places`` has, with the text's tag
        in their upper half, the words at which windows begin that also start in a smaller document.  Earlier batches are read through runs only.  The verdict is over the batch
        and all before it; a later batch does not change it, so batches should come by ascending id where ids decide who is first.
        """
        if len(self.runs["fps"]) >= self.fan_in:
            self.compact(self.fan_in)
        work, tmp = self.work, f"tmp-{uuid.uuid4().hex}"
        digest = F.unhex(F.md5("text"))
        rows = batch.where("text is not null").select("doc_id", digest.alias("digest"))
        least, most = F.min("doc_id").alias("first"), F.max("doc_id").alias("last")
        new, known = self._known(rows.groupBy("digest").agg(least, most), "digests", ["digest"], ["first", "last"])
        added = {"digests": self._store("digests", new.select("digest", F.least("first", *known["first"], F.lit(None)).alias("first"), F.greatest("last", *known["last"], F.lit(None)).alias("last")))}

        # the smallest document of a text that several have is sent to SALTS parts of their rows
        several = self._plain(added["digests"]).where("first < last").select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        salted = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
        copies = salted.join(several, ["digest", "salt"]).where("doc_id > first").select(F.col("doc_id").alias("copy_id"), F.col("digest").alias("copy_digest")).distinct()
        tag = F.coalesce(F.conv(F.substring(F.md5("text"), 1, 7), 16, 10).cast("long"), F.lit(0))
        # joined by id alone, as the run is dealt by it: texts are shuffled once
        texts = batch.join(copies, (F.col("doc_id") == F.col("copy_id")) & F.array_contains(F.array("copy_digest"), digest), "left")
        added["texts"] = self._store("texts", texts.select("doc_id", "text", F.col("copy_id").isNotNull().alias("copy"), tag.alias("tag")))
        work.release_shuffles()

        postings = work.write(_postings(self._plain(added["texts"]).where("not copy").select("doc_id", "text")), f"{tmp}-postings")
        new, known = self._known(postings.groupBy("fp").agg(least, most), "fps", ["fp"], ["first", "several"])
        old_first = F.least(*known["first"], F.lit(None), F.lit(None)).cast("long")
        old_several = reduce(lambda a, b: a | b, [F.coalesce(x, F.lit(False)) for x in known["several"]], F.lit(False))
        several = (F.col("first") != F.col("last")) | old_several | F.coalesce(old_first != F.col("first"), F.lit(False))
        lone = F.when(~old_several & (old_first != F.col("first")) | (~old_several & (F.col("first") != F.col("last"))), old_first)
        added["fps"] = self._store("fps", new.select("fp", F.least("first", old_first).alias("first"), several.alias("several"), lone.alias("promoted")))
        work.release_shuffles()

        fresh = self._plain(added["fps"]).where("several")
        hits = postings.join(fresh.select("fp"), "fp", "left_semi").groupBy("doc_id").agg(F.collect_set("fp").alias("fps"))
        found = [self._table(added["texts"]).where("not copy").join(hits, "doc_id")]
        promoted = fresh.where("promoted is not null")
        if self.runs["texts"] and not promoted.isEmpty():
            wanted = promoted.groupBy(F.col("promoted").alias("doc_id")).agg(F.collect_set("fp").alias("fps"))
            found += [self._table(name).where("not copy").join(wanted, "doc_id") for name in self.runs["texts"]]
        with _sorted_scans(self.spark):
            windows = work.write(reduce(DataFrame.union, [_windows(x.select("doc_id", "tag", "text", "fps")) for x in found]), f"{tmp}-windows")
        work.release_shuffles()

        key = ["wa", "wb"]
        new, known = self._known(windows.groupBy(*key).agg(least, most), "windows", key, ["first", "last"])
        added["windows"] = self._store("windows", new.select(*key, F.least("first", *known["first"], F.lit(None)).alias("first"), F.greatest("last", *known["last"], F.lit(None)).alias("last")))
        work.release_shuffles()
        shared = self._plain(added["windows"]).where("first < last").select(*key, "first")
        marks = windows.join(shared, key).where("doc_id > first").groupBy("doc_id").agg(F.collect_list("place").alias("places"))
        added["marks"] = self._store("marks", marks)
        for kind, name in added.items():
            self.runs[kind].append(name)
        self._commit()
        for name in ("postings", "windows"):
            work.drop(f"{tmp}-{name}")
        work.release_shuffles()
        return self._verdict(added["texts"], added["marks"])

    def _verdict(self, texts: str, marks: str) -> DataFrame:
        out = self._table(texts).join(self._table(marks).hint("merge"), "doc_id", "left")
        return out.select("doc_id", "text", "copy", "tag", F.coalesce("places", F.array().cast("array<long>")).alias("places"))

    def verdicts(self) -> DataFrame:
        """The verdicts of all batches so far, each as it was given."""
        return reduce(DataFrame.union, [self._verdict(*pair) for pair in zip(self.runs["texts"], self.runs["marks"])])

    def compact(self, most: int = 2) -> None:
        """Merges the last two runs of a kind, bucket by bucket without a shuffle, while it has ``most`` or more; commits that and
        deletes the merged ones.  Texts and marks are logs and stay."""
        old = []
        for kind in ("digests", "fps", "windows"):
            while len(self.runs[kind]) >= most:
                *rest, a, b = self.runs[kind]
                columns, keys = KINDS[kind]
                names = [c.split()[0] for c in columns.split(", ")]
                left, right = self._table(a), self._table(b).select(*[F.col(c).alias(f"{c}_") for c in names])
                both = left.join(right.hint("merge"), reduce(lambda x, y: x & y, [F.col(c) == F.col(f"{c}_") for c in names[:keys]]), "full")
                made = {c: F.coalesce(c, f"{c}_") for c in names[:keys]} | {"first": F.least("first", "first_")}
                if kind != "fps":
                    made["last"] = F.greatest("last", "last_")
                if kind == "fps":
                    made["several"] = F.coalesce("several", F.lit(False)) | F.coalesce("several_", F.lit(False)) | F.coalesce(F.col("first") != F.col("first_"), F.lit(False))
                    made["promoted"] = F.lit(None).cast("long")
                old += [a, b]
                self.runs[kind] = [*rest, self._store(kind, both.select(*[x.alias(c) for c, x in made.items()]), merged=True)]
        if old:
            self._commit()
        for name in old:
            self._forget(name)
            self.work.drop(name)

    def _forget(self, name: str) -> None:
        if table := self._tables.pop(name, None):
            self.spark.sql(f"DROP TABLE IF EXISTS {table}")

    def close(self) -> None:
        """Takes the runs out of the session's catalog; their files stay, and DataFrames that read them still do."""
        for name in list(self._tables):
            self._forget(name)

    def drop_search(self) -> None:
        """Deletes the runs that only further batches need; verdicts stay."""
        for kind in ("digests", "fps", "windows"):
            for name in self.runs[kind]:
                self._forget(name)
                self.work.drop(name)
            self.runs[kind] = []


def _batch_words(texts):
    """(words of all texts in a row, text of each word, text of each window, whether the window lies in that text)."""
    import numpy as np

    words, sizes = [], []
    for text in texts:
        found = (text.as_py() or "").encode().split()
        words += found
        sizes.append(len(found))
    sizes = np.array(sizes, np.int64)
    of = np.repeat(np.arange(len(sizes)), sizes)
    count = max(0, len(words) - WINDOW + 1)
    fits = of[:count] == of[len(words) - count :]
    return words, of, of[:count], fits


def _postings(docs: DataFrame) -> DataFrame:
    """(fp, doc_id): a document's fingerprints, of neighbouring windows once."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            words, _, of, fits = _batch_words(batch.column("text"))
            fps = fingerprints(_word_hashes(words))
            new = fits.copy()
            new[1:] &= (fps[1:] != fps[:-1]) | ~fits[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(fps[new]), batch.column("doc_id").take(pa.array(of[new]))], ["fp", "doc_id"])

    return docs.mapInArrow(run, "fp long, doc_id long")


def _windows(docs: DataFrame) -> DataFrame:
    """(wa, wb, doc_id, place): place (the tag in its upper half) and 128-bit digest of the words of every window whose fingerprint is
    in a list ``fps`` of the batch.  A list has all shared fingerprints of its document, so lists of other documents add nothing."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh3_128_digest

        for batch in batches:
            words, all_of, of, fits = _batch_words(batch.column("text"))
            wanted = batch.column("fps").flatten().to_numpy(zero_copy_only=False)
            at = np.flatnonzero(fits & np.isin(fingerprints(_word_hashes(words)), wanted))
            joined = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            begins = ends - np.fromiter(map(len, words), np.int64, len(words)) - 1
            digests = [xxh3_128_digest(joined[a:b]) for a, b in zip(begins[at].tolist(), (ends[at + WINDOW - 1] - 1).tolist())]
            both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            first = np.searchsorted(all_of, np.arange(batch.num_rows))  # of each text's words
            tags = batch.column("tag").to_numpy()
            places = at - first[of[at]] + (tags[of[at]] << 32)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), batch.column("doc_id").take(pa.array(of[at])), pa.array(places)], ["wa", "wb", "doc_id", "place"])

    return docs.mapInArrow(run, "wa long, wb long, doc_id long, place long")


def _removed(verdicts: DataFrame) -> DataFrame:
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from hashlib import sha256

        for batch in batches:
            out = []
            for text, copy, tag, places in zip(batch.column("text"), batch.column("copy").to_pylist(), batch.column("tag").to_pylist(), batch.column("places")):
                words = (text.as_py() or "").encode().split()
                n, kept = len(words), words
                if copy and n >= WINDOW:
                    kept = []
                elif len(places.values):
                    at = places.values.to_numpy()
                    begun = np.bincount(at[at >> 32 == tag] & 0xFFFFFFFF, minlength=n + WINDOW).astype(bool).astype(np.int64)
                    begun[WINDOW:] -= begun[:-WINDOW].copy()
                    gone = np.cumsum(begun)[:n] > 0
                    kept = [w for w, g in zip(words, gone.tolist()) if not g]
                joined = b" ".join(kept)
                out.append((n, n - len(kept), sha256(joined).hexdigest(), joined.decode()))
            n, gone, sha, kept = zip(*out) if out else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    return verdicts.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


def absorb_documents(docs: DataFrame, index: FingerprintIndex, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) of a batch against all that the index has seen; the batch joins the index."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    nobody = source.where("doc_id is null").withColumns({"copy": F.lit(False), "tag": F.lit(0).cast("long"), "places": F.array().cast("array<long>")})
    return _removed(index.absorb(source.where("doc_id is not null")).union(nobody))


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept_text) of every row: words covered by a window that also
    starts in a document with a smaller id are removed; windows are judged on the input.

    Words are divided by ASCII white space.  Documents enter a fresh index in ``batches`` by ascending id; ``absorb_documents`` does
    the same for batches that come one by one.  A text that equals one of a smaller id loses all its words if it has a window, and
    is left out of the comparison of windows: nothing else can depend on it.  Null and empty texts have no words; a null id neither
    loses words nor makes others lose any; equal windows of one id (repeated rows, repeats inside a text) stay; rows that repeat an
    id are one document, also if their texts differ (told apart by 28 bits of a digest); very long texts are handled whole in their
    task; an empty table gives no rows; other columns, whatever their names, are not read.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    named = source.where("doc_id is not null")
    index = FingerprintIndex(Workspace(spark, "substring"))
    cuts = sorted(set(named.select(F.percentile_approx("doc_id", F.array(*[F.lit(i / batches) for i in range(1, batches)]))).first()[0] or [])) if batches > 1 else []
    out = []
    for low, high in zip([None, *cuts], [*cuts, None]):
        batch = source if low is None else named.where(F.col("doc_id") > low)
        if high is not None:
            batch = batch.where(F.col("doc_id").isNull() | (F.col("doc_id") <= high))
        out.append(absorb_documents(batch, index))
    index.drop_search()
    index.close()
    return reduce(DataFrame.union, out)
