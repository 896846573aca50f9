"""Token ids of whole texts by a word-level BPE tokenizer file, one tokenizer call per new word.

The tokenizer drops white space and never merges across it, so a text's ids are the ids of
its white-space separated chunks, and a chunk that ends in a letter followed by ASCII
punctuation is the ids of both parts. The letter has to be one in lower case too: that of a capital I with a
dot ends in a mark, which joins the punctuation.

Chunks are cut, and the equal ones of a batch found, for whole batches by numpy and Arrow; only different chunks become
Python objects. An ASCII letter before ASCII punctuation ends a chunk already there, as the tokenizer cuts at that place too.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np
import pyarrow as pa

from cohortflow.llm.chunks import ChunkTable

GROUP = 64          # words of letters in one tokenizer call
TAIL = b".,!?;:*&%$#|"
ALPHABET = b"abcdefghijklmnopqrstuvwxyz"
OTHER, SPACE, LETTER, MARK = range(4)
KINDS = np.zeros(256, dtype=np.uint8)       # of bytes; letters of lower case only
for _kind, _bytes in ((SPACE, b" \t\n\r\v\f"), (LETTER, ALPHABET), (MARK, TAIL)):
    KINDS[list(_bytes)] = _kind

_tables: dict[tuple, "WordIds"] = {}


def word_ids(path: str, **limits) -> "WordIds":
    """The worker's table of a tokenizer file, with the limits of a ChunkTable."""
    key = (path, *sorted(limits.items()))
    if key not in _tables:
        _tables[key] = WordIds(path, **limits)
    return _tables[key]


class WordIds:
    def __init__(self, path: str, end_id: int = 0, **limits):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)       # tokens that end a word
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        # if the steps before the model leave words of ``ALPHABET`` as they are, a cut at white space is all these need
        self.plain, word = None, ALPHABET.decode()
        normalise, cut = self.tokenizer.normalizer, self.tokenizer.pre_tokenizer
        added = self.tokenizer.get_added_tokens_decoder().values()
        if (normalise and cut and normalise.normalize_str(word) == word and not any(t.content.isalpha() for t in added)
                and [w for w, _ in cut.pre_tokenize_str(word)] == [word]):
            self.plain = Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = WhitespaceSplit()
        # the empty chunk stands for the end of a text
        self.table = ChunkTable(self._learn, "I", {b"": [end_id]}, **limits)

    def _encode(self, texts: list[str], tokenizer=None) -> list[list[int]]:
        return [e.ids for e in (tokenizer or self.tokenizer).encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str], tokenizer=None) -> list[list[int] | None]:
        """Ids of words of letters, which go to the tokenizer many at a time and are cut again at word ends."""
        out: list[list[int] | None] = []
        groups = [words[k:k + GROUP] for k in range(0, len(words), GROUP)]
        for group, ids in zip(groups, self._encode([" ".join(g) for g in groups], tokenizer)):
            stops = (np.nonzero(self.ends[ids])[0] + 1).tolist()
            # else some letters were no single word after normalisation
            out += [ids[a:b] for a, b in zip([0, *stops], stops)] if len(stops) == len(group) else [None] * len(group)
        return out

    def _ids(self, chunks: list[bytes]) -> list[list[int]]:
        """Ids of each chunk."""
        texts = [c.decode("utf-8", "replace") for c in chunks]
        words = [i for i, t in enumerate(texts) if t.isalpha()]
        out: list[list[int] | None] = [None] * len(texts)
        for i, ids in zip(words, self._words([texts[i] for i in words])):
            out[i] = ids
        rest = [i for i, o in enumerate(out) if o is None]
        for i, ids in zip(rest, self._encode([texts[i] for i in rest])):
            out[i] = ids
        return out

    def _learn(self, chunks: list[bytes]) -> list[list[int]]:
        known: dict[bytes, list[int] | None] = {}
        if self.plain:
            words = [c for c in chunks if c.isalpha() and c.islower()]      # of ASCII letters, as these are bytes
            known.update(zip(words, self._words(b" ".join(words).decode().split(), self.plain)))
        rest = [c for c in chunks if known.get(c) is None]
        known.update(zip(rest, self._learn_rest(rest)))
        return [known[c] for c in chunks]

    def _learn_rest(self, chunks: list[bytes]) -> list[list[int]]:
        split = {}
        for w, core in zip(chunks, [w.rstrip(TAIL) for w in chunks]):
            if len(core) < len(w) and core and core.decode("utf-8", "replace")[-1:].lower()[-1:].isalpha():
                split[w] = (core, w[len(core):])
        known = {p: self.table.find(p) for p in set(chain.from_iterable(split.values()))}
        fresh = list({p for p, ids in known.items() if ids is None}.union(w for w in chunks if w not in split))
        known.update(zip(fresh, self._ids(fresh)))
        return [[*known[split[w][0]], *known[split[w][1]]] if w in split else known[w] for w in chunks]

    def _chunks(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """Different chunks of all texts, the number of every chunk among them, and how many chunks each text has.

        Every text ends with an empty chunk.
        """
        # lower case here saves chunks; marks and special tokens need the text as it is, and special tokens whole
        whole = [b"<|" in t or b"\xcc" in t or b"\xcd" in t for t in texts]
        data = np.frombuffer(b"".join([t if w else t.lower() for t, w in zip(texts, whole)]), dtype=np.uint8)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        kinds = KINDS[data]
        held = kinds != SPACE
        begins = held.copy()
        begins[1:] &= ~held[:-1] | ((kinds[:-1] == LETTER) & (kinds[1:] == MARK))
        for k in np.flatnonzero(whole).tolist():
            at = slice(ends[k] - len(texts[k]), ends[k])
            begins[at] = held[at]
            begins[at][1:] &= ~held[at][:-1]
        firsts = np.concatenate([[0], ends])
        firsts = firsts[firsts < len(data)]
        begins[firsts] = held[firsts]
        # without the white space chunks stand one behind the other, as in an Arrow array
        stops = ends - np.searchsorted(np.flatnonzero(~held), ends)
        starts = np.flatnonzero(begins[held])
        before = np.searchsorted(starts, stops)
        offsets = np.append(np.insert(starts, before, stops), stops[-1:]).astype(np.int32)
        coded = pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [
            None, pa.py_buffer(offsets), pa.py_buffer(data[held])]).dictionary_encode()
        return coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(), np.diff(before, prepend=0) + 1

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row (uint32, each text followed by the end id) and the number of each text."""
        if not texts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        chunks, codes, counts = self._chunks(texts)
        numbers, sizes = self.table.gather(chunks)
        froms, own = (np.cumsum(sizes) - sizes)[codes], sizes[codes]
        upto = np.cumsum(own)
        ids = numbers[np.arange(upto[-1]) + np.repeat(froms - upto + own, own)]
        return ids, np.diff(upto[np.cumsum(counts) - 1], prepend=0)
