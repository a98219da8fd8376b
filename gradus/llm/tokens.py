"""Token ids and counts with per-worker caches of space-delimited units.

Both tokenizers treat a text as independent units if it is cut before certain spaces, so each distinct
unit is encoded by its library once per worker and then looked up.  Texts with white-space runs for
which a cut could change the result, and texts holding an added token's string, are encoded whole.
"""

from __future__ import annotations

import os
import re

#: Distinct units kept per worker (about 200 MB).
MAX_UNITS = 1_200_000
#: Longer units are encoded each time: a few of them could fill the cache's memory.
LONG_UNIT = 200


class UnitCache:
    """What units gave, in two generations: when the young one has half of ``most`` units, it becomes the old one, so units in
    use stay and those seen once go."""

    def __init__(self, most: int):
        self.half, self.young, self.old = max(1, most // 2), {}, {}

    def look_up(self, units: list[str], make) -> list:
        """The value of each distinct unit; make(list of new units) gives those of the new ones."""
        if len(self.young) > self.half:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        found = list(map(young.get, units))
        absent = [i for i, x in enumerate(found) if x is None]
        new = []
        for i in absent:
            x = old.get(units[i])
            if x is None:
                new.append(i)
            else:
                found[i] = young[units[i]] = x
        for i, x in zip(new, make([units[i] for i in new])):
            found[i] = x
            if len(units[i]) <= LONG_UNIT:
                young[units[i]] = x
        return found


class UnitEncoder:
    """Ids of a byte-level BPE of the tokenizers library, as little-endian bytes of ``width`` each.

    The pre-tokenizer takes `` ?letters``, `` ?digits``, `` ?others``, ``\\s+(?!\\S)`` and ``\\s+``; a token
    thus holds a space at its start or in a white-space run.  Cutting before a space changes nothing unless
    that space has white space on its left and white space or the end on its right.
    """

    _UNSAFE = re.compile(r"\s (?:\s|\Z)")

    def __init__(self, path: str, max_units: int = MAX_UNITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import numpy as np
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.dtype = f"<u{self.width}"
        self._added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        kind = repr(self.tokenizer.pre_tokenizer)
        self._units = self.tokenizer.normalizer is None and kind.startswith("ByteLevel(add_prefix_space=False") and "use_regex=True" in kind
        self._cache = UnitCache(max_units)
        vocabulary = self.tokenizer.get_vocab()
        self._spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self._spaced[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True

    def _bytes(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _unit_bytes(self, units: list[str], run: int = 500) -> list[bytes]:
        """Ids of " " + unit each.  Units without white space at an end are encoded many at once, which is safe as
        cutting there is, and told apart by the tokens that start with a space."""
        import numpy as np

        out: list[bytes] = [b""] * len(units)
        whole = [bool(u) and u.strip() == u for u in units]
        joined = [i for i, ok in enumerate(whole) if ok]
        alone = [i for i, ok in enumerate(whole) if not ok]
        groups = [joined[at : at + run] for at in range(0, len(joined), run)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast(["".join(" " + units[i] for i in g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, self.dtype)
            at = (np.flatnonzero(self._spaced[ids]) * self.width).tolist()
            if len(at) == len(group):
                raw = ids.tobytes()
                for i, a, b in zip(group, at, [*at[1:], len(raw)]):
                    out[i] = raw[a:b]
            else:
                alone += group
        for i, x in zip(alone, self._bytes([" " + units[i] for i in alone])):
            out[i] = x
        return out

    def encode(self, texts) -> list[bytes]:
        """Ids of each text of an Arrow array or list; null and empty texts give none."""
        import numpy as np
        import pyarrow as pa

        texts = texts.to_pylist() if isinstance(texts, pa.Array) else texts
        out: list[bytes] = [b""] * len(texts)
        cut: list[int] = []
        whole: list[int] = []
        for i, text in enumerate(texts):
            if text:
                safe = self._units and not self._UNSAFE.search(text) and not any(a in text for a in self._added)
                (cut if safe else whole).append(i)
        for i, ids in zip(whole, self._bytes([texts[i] for i in whole])):
            out[i] = ids
        if not cut:
            return out
        starts, index, units = _split([texts[i] for i in cut])
        taken = pa.array(self._cache.look_up(units, self._unit_bytes), pa.binary()).take(index)
        at = np.frombuffer(taken.buffers()[1], np.int32, len(taken) + 1, taken.offset * 4).tolist()
        data = taken.buffers()[2].to_pybytes() if taken.buffers()[2] else b""
        heads = self._bytes([texts[i].split(" ", 1)[0] for i in cut])  # a text's first unit has no space before it
        for i, head, a, b in zip(cut, heads, starts[:-1], starts[1:]):
            out[i] = head + data[at[a + 1] : at[b]]
        return out


def _split(texts: list[str]):
    """(offsets, index, units): the pieces of texts between spaces, text after text, as an index into distinct units."""
    import pyarrow as pa
    import pyarrow.compute as pc

    parts = pc.split_pattern(pa.array(texts, pa.string()), " ")
    coded = parts.values.dictionary_encode()
    return parts.offsets.to_pylist(), coded.indices, coded.dictionary.to_pylist()


class UnitCounter:
    """Token counts of a sentencepiece model or of a tokenizers file.

    A single space between two characters that are neither spaces nor the model's space mark is a safe
    boundary if no piece of the vocabulary holds the mark after another character: the right part gets
    back its mark as the dummy prefix.
    """

    _SAFE = re.compile("(?<=[^ ▁]) (?=[^ ▁])")

    def __init__(self, path: str, max_units: int = MAX_UNITS):
        self._cache = UnitCache(max_units)
        self._encoder = None
        if path.endswith(".json"):
            self._encoder = UnitEncoder(path, max_units)
            return
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = (self._model.id_to_piece(i) for i in range(len(self._model)))
        probes = ("x", "x y", "x  y", "Ａ", "x\ty")
        plain = all(self._model.decode(self._model.encode(p)) == p for p in probes)  # nothing is normalised away
        marked = self._model.encode("x", out_type=str)[0].startswith("▁")  # the dummy prefix is on
        self._units = plain and marked and not any("▁" in p.lstrip("▁") for p in pieces)

    def _lengths(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self._model.encode(texts, num_threads=1)] if texts else []

    def count(self, texts) -> list[int]:
        """Token counts of an Arrow array or list of texts; null and empty texts have none."""
        import numpy as np
        import pyarrow as pa

        if self._encoder:
            return [len(x) // self._encoder.width for x in self._encoder.encode(texts)]
        texts = [t or "" for t in (texts.to_pylist() if isinstance(texts, pa.Array) else texts)]
        if not self._units:
            return self._lengths(texts)
        out, cut = [0] * len(texts), []
        for i, t in enumerate(texts):
            if "  " not in t and "▁" not in t and t[:1] != " " and t[-1:] != " ":
                cut.append(i)
            else:
                out[i] = sum(self._lengths(self._SAFE.split(t)))
        if not cut:
            return out
        starts, index, units = _split([texts[i] for i in cut])
        found = self._cache.look_up(units, self._lengths)
        ends = np.concatenate([[0], np.cumsum(np.array(found, np.int64)[index.to_numpy()])])
        for i, a, b in zip(cut, starts[:-1], starts[1:]):
            out[i] = int(ends[b] - ends[a])
        return out


_loaded: dict[tuple[type, str], object] = {}


def worker(kind: type, path: str):
    """One encoder per Python worker and file."""
    key = (kind, path)
    if key not in _loaded:
        _loaded[key] = kind(path)
    return _loaded[key]


def by_bytes(batches, column: str, limit: int = 8_000_000):
    """Arrow batches dealt anew so that each holds about ``limit`` bytes of that string column: small ones are joined,
    large ones cut; a row is never divided."""
    import pyarrow as pa
    import pyarrow.compute as pc

    held, size = [], 0

    def joined():
        whole = pa.Table.from_batches(held).combine_chunks().to_batches()
        held.clear()
        return whole

    for batch in batches:
        start = 0
        for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            if size and size + n > limit:
                if i > start:
                    held.append(batch.slice(start, i - start))
                start, size = i, 0
                yield from joined()
            size += n
        if start < batch.num_rows:
            held.append(batch.slice(start))
    if held:
        yield from joined()
