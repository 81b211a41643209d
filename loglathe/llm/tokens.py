"""Token ids of the public byte-level BPE vocabularies."""

from __future__ import annotations

import re

#: Here both libraries' splitting patterns agree character by character; other texts take the reference tokenizer.
_PLAIN = re.compile("[\t\n\r -~¡-ɏ]*")
EOT = "<|endoftext|>"


class Encoder:
    """Encodes texts to the ids that ``tokenizers`` gives for a vocabulary file (add_special_tokens=False).

    The same ranks are loaded into ``tiktoken``, which is several times faster; it serves texts of plain Latin
    characters without the special token's string. All others go to ``tokenizers`` itself.
    """

    def __init__(self, vocabulary: str | None = None) -> None:
        import base64

        import public_tokenizers as public
        import tiktoken
        from tokenizers import Tokenizer

        path = vocabulary or public.path("byte_bpe_50k.json")
        self.exact = Tokenizer.from_file(path)
        self.fast = None
        if path == public.path("byte_bpe_50k.json"):
            with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.fast is not None and _PLAIN.fullmatch(text) and EOT not in text:
            return self.fast.encode_ordinary(text)
        return self.exact.encode(text, add_special_tokens=False).ids

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        return [self.encode(t) for t in texts]


def id_type(vocabulary: str | None = None) -> str:
    """The numpy type that holds a vocabulary's ids: 16 bits unless it has more than 65,536."""
    import public_tokenizers as public
    from tokenizers import Tokenizer

    size = Tokenizer.from_file(vocabulary or public.path("byte_bpe_50k.json")).get_vocab_size()
    return "<u2" if size <= 1 << 16 else "<u4"
