"""Chat formatting with loss masks from token offsets.

A conversation is rendered as ``<|turn|>role<|says|>text<|end|>`` lines. The markers are
special tokens, so no token crosses them and token spans meet turn spans exactly. Inside
roles and texts ``\\`` is doubled and ``<|`` becomes ``<\\|``, so no marker can occur
there and reading back is exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

TURN, SAYS, END = "<|turn|>", "<|says|>", "<|end|>"
CHAT = "conv_id long, part int, first_turn long, n_turns long, formatted string, token_ids array<int>, loss_mask array<boolean>, loss_spans array<int>"
DIGEST = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_tokens long, n_loss_tokens long"
_READ = re.compile(re.escape(TURN) + r"(.*?)" + re.escape(SAYS) + r"(.*?)" + re.escape(END) + "\n", re.S)
_ESCAPED = re.compile(r"\\(.)", re.S)


def escape(s: str) -> str:
    return s.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(s: str) -> str:
    return _ESCAPED.sub(r"\1", s) if "\\" in s else s


def render(turns: list[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, np.ndarray]:
    """The formatted text and the sorted spans, in code points, of the texts that count for the loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{SAYS}", escape(text)
        if role == loss_role:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def read_back(formatted: str) -> list[tuple[str, str]]:
    return [(unescape(r), unescape(t)) for r, t in _READ.findall(formatted)]


def token_mask(offsets: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """True for tokens that share a code point with a span; both lists are sorted."""
    if not len(spans):
        return np.zeros(len(offsets), bool)
    k = np.searchsorted(spans[:, 1], offsets[:, 0], "right")  # the first span that ends after the token's start
    start = spans[np.minimum(k, len(spans) - 1), 0]
    return (k < len(spans)) & (start < offsets[:, 1]) & (offsets[:, 0] < offsets[:, 1])


def masked_spans(offsets: np.ndarray, mask: np.ndarray) -> list[tuple[int, int]]:
    """The code points under the mask as maximal spans."""
    out: list[tuple[int, int]] = []
    for a, b in offsets[mask].tolist():
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_tokenizers: dict[str, object] = {}


def chat_tokenizer(path: str):
    """The tokenizer with the markers as special tokens and untrimmed offsets."""
    if path not in _tokenizers:
        from tokenizers import AddedToken, Tokenizer, processors

        t = Tokenizer.from_file(path)
        t.add_special_tokens([AddedToken(m, normalized=False, special=True) for m in (TURN, SAYS, END)])
        t.post_processor = processors.ByteLevel(trim_offsets=False)
        _tokenizers[path] = t
    return _tokenizers[path]


def conversations_of(batches: Iterator[pd.DataFrame], most_chars: int) -> Iterator[tuple[int, int, list[tuple[str, str]]]]:
    """(conversation, part, turns) of rows sorted by conversation and turn.

    A conversation over ``most_chars`` comes in several parts, so memory stays bounded. Every
    turn ends with a marker, so the parts' encodings in a row are the whole's.
    """
    conv, part, turns, size = None, 0, [], 0
    for pdf in batches:
        for c, role, text in zip(pdf["conv_id"], pdf["role"], pdf["text"], strict=True):
            if turns and (c != conv or size > most_chars):
                yield conv, part, turns
                part, turns, size = (part + 1 if c == conv else 0), [], 0
            elif c != conv:
                part = 0
            conv = c
            turns.append((role, text))
            size += len(text)
    if turns:
        yield conv, part, turns


def _sorted(conversations: DataFrame) -> DataFrame:
    rows = conversations.select(shared.id_in("conv_id"), "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")


def _encode(tokenizer, formatted: str, spans: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
    e = tokenizer.encode(formatted, add_special_tokens=False)
    offsets = np.array(e.offsets, np.int64).reshape(-1, 2)
    return e.ids, offsets, token_mask(offsets, spans)


def format_chats(conversations: DataFrame, tokenizer: str, loss_role: str = "assistant", most_chars: int = 1_000_000) -> DataFrame:
    """Formatted conversations with token ids, the token loss mask and its spans in code points.

    One row per conversation, or several by ``part`` where it exceeds ``most_chars``; spans
    count from the start of the row's text. Rows are ordered by turn (nulls first, ties by
    role and text); null roles and texts are empty; rows with a null conv_id form one
    conversation; an empty table gives no row; further columns are ignored.
    """
    shared.share_code(conversations.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, done, last = chat_tokenizer(tokenizer), 0, None
        for conv, part, turns in conversations_of(batches, most_chars):
            done = 0 if conv != last or not part else done
            formatted, spans = render(turns, loss_role)
            ids, offsets, mask = _encode(t, formatted, spans)
            flat = [x for s in masked_spans(offsets, mask) for x in s]
            yield pd.DataFrame({"conv_id": [conv], "part": [part], "first_turn": [done], "n_turns": [len(turns)], "formatted": [formatted], "token_ids": [ids], "loss_mask": [mask], "loss_spans": [flat]})
            last, done = conv, done + len(turns)

    return shared.id_out(_sorted(conversations).mapInPandas(run, CHAT), "conv_id")


def chat_digests(conversations: DataFrame, tokenizer: str, loss_role: str = "assistant", most_chars: int = 1_000_000) -> DataFrame:
    """What reading the formatted conversations and their loss masks back gives, one row per conversation.

    Nulls, ties and empty tables as in ``format_chats``. Parts of one conversation are
    digested as they pass, so the longest conversation needs no more memory than a part.
    """
    shared.share_code(conversations.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        t, rows, names = chat_tokenizer(tokenizer), [], [c.split()[0] for c in DIGEST.split(", ")]
        now: list = []  # of the conversation at hand: id, turns, hash, loss characters, loss hash, characters, tokens, loss tokens

        def row() -> tuple:
            return (*now[:2], now[2].hexdigest(), now[3], now[4].hexdigest(), *now[5:])

        for conv, part, turns in conversations_of(batches, most_chars):
            if not part:
                if now:
                    rows.append(row())
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
                if len(rows) >= 1000:
                    yield pd.DataFrame(rows, columns=names)
                    rows = []
            formatted, spans = render(turns, loss_role)
            ids, offsets, mask = _encode(t, formatted, spans)
            for role, text in read_back(formatted):
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
            for a, b in masked_spans(offsets, mask):
                said = unescape(formatted[a:b])
                now[3] += len(said)
                now[4].update(said.encode("utf-8", "surrogatepass"))
            now[5] += len(formatted)
            now[6] += len(ids)
            now[7] += int(mask.sum())
        if now:
            rows.append(row())
        yield pd.DataFrame(rows, columns=names)

    return shared.id_out(_sorted(conversations).mapInPandas(run, DIGEST), "conv_id")
