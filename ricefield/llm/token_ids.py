"""Token ids of whole texts with a public tokenizer, each distinct piece encoded once.

The ids are those of ``Tokenizer.encode(text, add_special_tokens=False)`` with special
tokens' strings read as ordinary text.  Pre-tokenization splits at places that can be
seen in the text, so a batch's texts are cut there, each distinct piece is encoded by
the library once, and the ids are put together again:

* a text is cut at white space (for the byte-level tokenizer a blank stays with the word
  that follows it, and a line break stands alone);
* a unit without an apostrophe is cut where letters, digits and other characters meet.

Only texts whose cuts are certain are cut: Latin-1 characters (which need no
normalisation), blanks and line breaks that stand alone.  All others go to the library
whole.  The units of earlier batches are known with their ids up to ``KNOWN`` of them, so
small batches cost no more than large ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ricefield.llm.common import ragged_take

BLANK, CUT = "\x01", "\x02"  # stand for a blank before a word, and for a cut between pieces
PLAIN = r"^[\n\x20-\x7e\x{a1}-\x{ff}]*$"
KNOWN, KNOWN_BYTES = 500_000, 8_000_000  # units of earlier batches whose ids are kept, and their text

END = "\x00"  # between pieces; no piece holds it


def _byte_letters() -> dict[int, int]:
    """The letters that byte-level models write for bytes: printable ones stand for themselves,
    the others are counted on from 256.  ``END`` stays."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(own)]
    return {b: 256 + k for k, b in enumerate(others) if b}


BYTE_LETTERS = _byte_letters()


class TokenIds:
    """``byte_level``: a blank belongs to the next word (the tokenizer keeps white space);
    otherwise white space is dropped and letters are lower-cased first."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.byte_level = self.whole.normalizer is None
        self.model = self.whole.model
        self.known = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of each text's ids); null is empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        plain = pc.match_substring_regex(texts, PLAIN)
        if self.byte_level:
            plain = pc.and_(plain, pc.invert(pc.match_substring_regex(texts, r"\s\s")))
        plain = plain.to_numpy(zero_copy_only=False)
        ids, counts = self._cut(texts.filter(pa.array(plain)))
        if plain.all():
            return ids, np.concatenate([[0], np.cumsum(counts)])
        rest = [e.ids for e in self.whole.encode_batch_fast(texts.filter(pa.array(~plain)).to_pylist(), add_special_tokens=False)]
        lengths = np.empty(len(plain), np.int64)
        lengths[plain], lengths[~plain] = counts, [len(x) for x in rest]
        starts = np.empty(len(plain), np.int64)
        starts[plain] = np.cumsum(counts) - counts
        starts[~plain] = len(ids) + np.cumsum(lengths[~plain]) - lengths[~plain]
        flat = np.concatenate([ids, *(np.array(x, np.uint32) for x in rest)])
        return ragged_take(flat, starts, lengths), np.concatenate([[0], np.cumsum(lengths)])

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and the number of ids of each text, for texts whose cuts are certain."""
        if self.byte_level:
            spaced = pc.replace_substring(pc.replace_substring(texts, " ", " " + BLANK), "\n", " \n ")
            lists = pc.split_pattern(spaced, " ")
        else:
            lists = pc.ascii_split_whitespace(pc.utf8_lower(texts))
        units = lists.flatten().dictionary_encode()
        ends = np.asarray(lists.offsets, dtype=np.int64)
        unit_ids, unit_counts, places = self._looked_up(units.dictionary)
        which = places[units.indices.to_numpy()]
        counts = unit_counts[which]
        ids = ragged_take(unit_ids, (np.cumsum(unit_counts) - unit_counts)[which], counts)
        before = np.concatenate([[0], np.cumsum(counts)])
        ends = before[ends - ends[0]]
        return ids, np.diff(ends)

    def _looked_up(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and number of ids of known and new units, and the place of each unit there."""
        names, ids, counts = self.known
        places = pc.index_in(units, value_set=names)
        new = places.is_null()
        fresh = units.filter(new)
        new_ids, new_counts = self._units(fresh)
        new = new.to_numpy(zero_copy_only=False)
        places = places.fill_null(0).to_numpy().astype(np.int64)
        places[new] = len(names) + np.arange(len(fresh))
        ids, counts = np.concatenate([ids, new_ids]), np.concatenate([counts, new_counts])
        names = pa.concat_arrays([names, fresh])
        if len(names) <= KNOWN and _text_bytes(names) <= KNOWN_BYTES:
            self.known = names, ids, counts
        elif len(units) <= KNOWN // 2 and _text_bytes(units) <= KNOWN_BYTES // 2:
            self.known = units, ragged_take(ids, (np.cumsum(counts) - counts)[places], counts[places]), counts[places]
        else:
            self.known = units[:0], ids[:0].copy(), counts[:0].copy()
        return ids, counts, places

    def _units(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids and number of ids of each distinct unit."""
        odd = pc.match_substring(units, "'")
        pieces = units
        for before, after in ((r"\p{L}", r"\P{L}"), (r"\p{N}", r"\P{N}"), (r"[^\p{L}\p{N}\x01]", r"[\p{L}\p{N}]")):
            pieces = pc.replace_substring_regex(pieces, f"({before})({after})", r"\1" + CUT + r"\2")
        lists = pc.split_pattern(pc.if_else(odd, units, pieces), CUT)
        distinct = lists.flatten().dictionary_encode()
        names = distinct.dictionary
        alone = pc.match_substring(names, "'")
        if not self.byte_level:
            alone = pc.or_(alone, pc.match_substring_regex(names, r"\p{N}"))  # its digits are cut singly
        alone = pc.or_(alone, pc.equal(names, "")).to_numpy(zero_copy_only=False)
        names = pc.replace_substring(names, BLANK, " ")
        piece_ids, piece_counts = self._pieces(names, alone)
        which = distinct.indices.to_numpy()
        counts = piece_counts[which]
        ids = ragged_take(piece_ids, (np.cumsum(piece_counts) - piece_counts)[which], counts)
        ends = np.asarray(lists.offsets, dtype=np.int64)
        return ids, np.diff(np.concatenate([[0], np.cumsum(counts)])[ends - ends[0]])

    def _pieces(self, names: pa.Array, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of one pre-token go to the tokenizer's model as they are, in its letters for
        bytes; the others are encoded by the library one by one."""
        counts, parts = np.zeros(len(names), np.int64), []
        single = np.flatnonzero(~alone)
        if len(single):
            letters = END.join(names.filter(pa.array(~alone)).to_pylist()).encode().decode("latin-1").translate(BYTE_LETTERS)
            letters, step = letters.split(END), 4096
            for at in range(0, len(letters), step):
                codes = [[t.id for t in self.model.tokenize(x)] for x in letters[at : at + step]]
                counts[single[at : at + step]] = [len(c) for c in codes]
                parts.append(np.array([i for c in codes for i in c], np.uint32))
        codes = self.whole.encode_batch_fast(names.filter(pa.array(alone)).to_pylist(), add_special_tokens=False)
        others = np.flatnonzero(alone)
        counts[others] = [len(c.ids) for c in codes]
        parts += [np.array(c.ids, np.uint32) for c in codes]
        flat = np.concatenate(parts) if parts else np.zeros(0, np.uint32)
        starts = np.empty(len(names), np.int64)
        order = np.concatenate([single, others])
        starts[order] = np.cumsum(counts[order]) - counts[order]
        return ragged_take(flat, starts, counts), counts


def _text_bytes(names: pa.Array) -> int:
    return pc.sum(pc.binary_length(names), min_count=0).as_py()


_LOADED: dict[str, TokenIds] = {}


def token_ids(path: str) -> TokenIds:
    """One per worker process and file; encoding runs in the task's own thread."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _LOADED:
        _LOADED[path] = TokenIds(path)
    return _LOADED[path]
