"""Token ids of whole texts, with caches for the pieces that texts share. Used inside tasks only."""

from __future__ import annotations

import os
import re
import struct
import sys

#: Bytes that all caches of a tokenizer take in one Python worker; beyond them, ids are computed each time.
CACHE_BYTES = 128 << 20
#: Punctuation that may end a chunk; apostrophes are left to the pre-tokenizer.
_TAIL = ".,;:!?$%&*#)(]["
#: Characters that str.split() takes for white space and the tokenizer does not.
_ODD_SPACE = re.compile("[\x1c-\x1f]")


class Room:
    """What is left of a number of bytes."""

    def __init__(self, size: int):
        self.left = size

    def keep(self, cache: dict, key: str, value: bytes) -> None:
        """Into ``cache``, if there is room for both objects and their entry."""
        cost = sys.getsizeof(key) + sys.getsizeof(value) + 100
        if cost <= self.left:
            self.left -= cost
            cache[key] = value


class Pieces(dict):
    """Pre-tokens, as the tokenizer's own pre-tokenizer gives them, to little-endian 32-bit ids."""

    def __init__(self, model, room: Room):
        super().__init__()
        self.model, self.room = model, room

    def __missing__(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece)]
        out = struct.pack(f"<{len(ids)}I", *ids)
        self.room.keep(self, piece, out)
        return out


class Chunks(dict):
    """Runs of characters between white space to ids: neither normalizer nor pre-tokenizer reaches across white space."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.normalizer, self.splitter = tokenizer, tokenizer.normalizer, tokenizer.pre_tokenizer
        self.room = Room(CACHE_BYTES)
        self.pieces, self.heads = Pieces(tokenizer.model, self.room), {}
        self.special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def general(self, chunk: str) -> bytes:
        return b"".join([self.pieces[p] for p, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(chunk))])

    def __missing__(self, chunk: str) -> bytes:
        if len(chunk) > 64 or "<|" in chunk and any(s in chunk for s in self.special):
            return self.whole(chunk)
        # punctuation after a letter or digit is a pre-token of its own, so most chunks are a known word and a known tail
        head = chunk.rstrip(_TAIL)
        if head and head[-1].isalnum():
            tail = chunk[len(head) :]
            if head.isascii() and head.isalpha():
                out = self.pieces[head.lower()]
            else:
                out = self.heads.get(head)
                if out is None:
                    out = self.general(head)
                    self.room.keep(self.heads, head, out)
            if tail:
                out += self.pieces[tail]
        else:
            out = self.general(chunk)
        self.room.keep(self, chunk, out)
        return out

    def ids(self, text: str) -> bytes:
        """Ids of ``text`` as little-endian unsigned 32-bit integers."""
        if _ODD_SPACE.search(text):
            return self.whole(text)
        return b"".join(map(self.__getitem__, text.split()))


#: Texts that a tokenizer has to cut like the chunks above; others are tokenized text by text.
PROBES = (
    "Don't we'll I'M 12.5% a,b (c) [d] e-f g_h #tag $5 & more; end.", "ÉCOLE straße ΑΣ. İstanbul ½ ２ e\u0301 \u00ad", "x1y2 ABC DEF's 's ''q' ?!.. a.b.c",
    "日本語 テキスト。 한국어 עברית", "😀 👩‍👩‍👧 a\u200db", "tabs\tand\n\nlines  two  spaces", " leading and trailing ", "ＦＵＬＬ Ｗidth ﬁ ǅ ß", "",
)
_loaded: dict[str, Chunks] = {}


def tokenizer(name: str) -> Chunks:
    """``name``: the path of a tokenizers file, or the name of one of the installed public vocabularies."""
    if name not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        from tokenizers import Tokenizer

        found = Chunks(Tokenizer.from_file(name if os.path.isabs(name) else public_tokenizers.path(name)))
        try:
            alike = all(found.ids(p) == found.whole(p) for p in PROBES)
        except Exception:  # without a normalizer or a pre-tokenizer there are no such chunks
            alike = False
        if not alike:
            found.ids = found.whole
        _loaded[name] = found
    return _loaded[name]
