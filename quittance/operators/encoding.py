"""Sub-word features of training sets: a tokenizer from its side files, boxes and labels aligned to sub-words, windows."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from tokenizers import Tokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import ByteLevel

from quittance.operators.models import ModelRegistry

NO_BOX = [0, 0, 0, 0]
#: Tokens of the windows that are filled together, about.
TOKENS = 1 << 17
#: Words whose sub-words a task remembers, at most; then it begins anew.
KNOWN_WORDS = 100_000


@dataclass(frozen=True)
class Rules:
    """What the side files say: ids that begin, end and fill a window, its length, and which sub-words have a label."""

    begin: int
    end: int
    pad: int
    length: int = 512
    ignore: int = -100
    first_only: bool = True

    def __post_init__(self) -> None:
        if self.length < 3:
            raise ValueError("a window has three tokens at least")


def _content(entry: object) -> str:
    """A special token's text: files have it plain, or as an object."""
    return entry["content"] if isinstance(entry, dict) else str(entry)


def load_side_files(folder: str) -> tuple[Tokenizer, Rules]:
    """The byte-level tokenizer of a model folder and its rules.

    The folder has ``tokenizer.json``, or ``vocab.json`` and ``merges.txt``, and
    beside it ``tokenizer_config.json`` and ``special_tokens_map.json``, either
    of which may lack.
    """
    base = Path(folder)
    settings: dict = {}
    for name in ("special_tokens_map.json", "tokenizer_config.json"):
        if (base / name).exists():
            settings |= json.loads((base / name).read_text(encoding="utf-8"))
    if (base / "tokenizer.json").exists():
        tokenizer = Tokenizer.from_file(str(base / "tokenizer.json"))
    else:
        tokenizer = Tokenizer(BPE.from_file(str(base / "vocab.json"), str(base / "merges.txt")))
        tokenizer.pre_tokenizer = ByteLevel(add_prefix_space=bool(settings.get("add_prefix_space", False)))

    def special(*names: str) -> int:
        for name in names:
            if name in settings and (found := tokenizer.token_to_id(_content(settings[name]))) is not None:
                return found
        raise ValueError(f"the side files name no token of the vocabulary as {' or '.join(names)}")

    rules = Rules(
        special("cls_token", "bos_token"), special("sep_token", "eos_token"), special("pad_token"),
        int(settings.get("model_max_length", 512)), int(settings.get("pad_token_label", -100)), bool(settings.get("only_label_first_subword", True)),
    )
    return tokenizer, rules


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    """Lists of ``sizes`` that follow each other in ``values``."""
    flat = values if isinstance(values, pa.Array) else pa.array(values)
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), flat)


def _sizes(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)


def _ranges(begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers from each ``begin`` on, as many as ``sizes`` says, one range after the other."""
    return np.repeat(begin - np.append(0, np.cumsum(sizes)[:-1]), sizes) + np.arange(sizes.sum()) if len(sizes) else np.empty(0, np.int64)


def windows(batch: pa.RecordBatch, known: dict[str, list[int]], rules: Rules, stride: int, overflow: bool) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """(the number of the example of each window, the window's number and its features) of a batch of examples, whose words are ``known``.

    All windows of a batch are filled together, as rows of one array. ``words`` is
    the number of each token's word, -1 for tokens that are none.
    """
    words, boxes, tags = (batch.column(c) for c in ("words", "bboxes", "ner_tags"))
    n_words, n_boxes, n_tags = map(_sizes, (words, boxes, tags))
    for w, b, t in zip(n_words, n_boxes, n_tags, strict=True):
        if not w == b == t:
            raise ValueError(f"{w} words, {b} boxes and {t} tags")
    flat_boxes = boxes.flatten()
    if len(flat_boxes) and not (_sizes(flat_boxes) == len(NO_BOX)).all():
        raise ValueError(f"a box has {len(NO_BOX)} numbers")
    if flat_boxes.flatten().null_count or tags.flatten().null_count:
        raise ValueError("a number of a box or a tag is null")
    box = np.vstack([flat_boxes.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, len(NO_BOX)), NO_BOX])
    tag = np.append(tags.flatten().to_numpy(zero_copy_only=False).astype(np.int64), rules.ignore)
    # sub-words: distinct words have their ids once, and each word a range of them
    coded = pc.fill_null(words.flatten(), "").dictionary_encode()
    pieces = [known[w] for w in coded.dictionary.to_pylist()]
    size = np.array([len(x) for x in pieces], np.int64)
    ids = np.fromiter(chain.from_iterable(pieces), np.int64, size.sum())
    code = coded.indices.to_numpy(zero_copy_only=False)
    n_ids = size[code]
    ids = ids[_ranges((np.cumsum(size) - size)[code], n_ids)]
    of_word = np.repeat(np.arange(len(code)), n_ids)
    first = _ranges(np.zeros(len(code), np.int64), n_ids) == 0
    # windows: their example, and where among the sub-words each begins and how many it has
    ends = np.append(0, np.cumsum(n_ids))[np.append(0, np.cumsum(n_words))]
    n, room = np.diff(ends), rules.length - 2
    count = np.maximum(1, -((stride - n) // (room - stride))) if overflow else np.ones(len(n), np.int64)
    example = np.repeat(np.arange(len(n)), count)
    number = _ranges(np.zeros(len(n), np.int64), count)
    own = np.minimum(room, n[example] - number * (room - stride))
    place = np.arange(rules.length)
    inside = (place >= 1) & (place <= own[:, None])
    at = np.where(inside, (ends[:-1][example] + number * (room - stride))[:, None] + place - 1, len(ids))
    word = np.append(of_word, len(code))[at]
    labelled = inside & (np.append(first, False)[at] if rules.first_only else True)
    token = np.append(ids, rules.pad)[at]
    token[:, 0], token[np.arange(len(own)), own + 1] = rules.begin, rules.end
    word_of_example = np.append(np.cumsum(n_words) - n_words, 0)[example][:, None]
    full = np.full(len(example), rules.length)
    return example, {
        "window": pa.array(number, pa.int32()), "n_windows": pa.array(count[example], pa.int32()), "input_ids": _lists(token.ravel(), full),
        "attention_mask": _lists((place <= own[:, None] + 1).astype(np.int64).ravel(), full), "bbox": _lists(_lists(box[word].ravel(), np.full(at.size, len(NO_BOX))), full),
        "labels": _lists(np.where(labelled, tag[word], rules.ignore).ravel(), full), "words": _lists(np.where(inside, word - word_of_example, -1).astype(np.int32).ravel(), full),
    }


def learn_words(tokenizer: Tokenizer, words: Iterable[str], known: dict[str, list[int]]) -> None:
    """Adds the sub-words of those ``words`` that are not in ``known`` yet, each cut on its own, in one call."""
    new = [w for w in dict.fromkeys(words) if w not in known]
    if new:
        found = tokenizer.encode_batch([[w] for w in new], is_pretokenized=True, add_special_tokens=False)
        known.update((w, e.ids) for w, e in zip(new, found, strict=True))


FEATURES = "n_windows int, input_ids array<long>, attention_mask array<long>, bbox array<array<long>>, labels array<long>, words array<int>"


def encode_words(examples: DataFrame, tokenizer: Tokenizer, rules: Rules, keys: tuple[str, ...] = ("id",), stride: int = 0, overflow: bool = True) -> DataFrame:
    """Features of examples with ``words``, ``bboxes`` and ``ner_tags``: a row for each window of ``rules.length`` tokens.

    Words are cut into sub-words each on its own; a sub-word has its word's box,
    and the word's label if it is the first. With ``overflow``, what does not
    fit goes to further windows, each beginning with the last ``stride`` tokens
    of the one before; without, it is cut off.

    Returns the keys, ``window``, n_windows and the features. The tokenizer is broadcast
    as text, of the size of its vocabulary, and built once in each worker; a word that
    comes again is not cut again.

    Edge cases: a null word is an empty one; empty words, and examples without
    words, have no sub-words (the window has begin and end only); words without
    a box or a tag are an error; a null list is an empty one.
    """
    if not 0 <= stride < rules.length - 2:
        raise ValueError("the stride is less than a window's room")
    spark = examples.sparkSession
    text = spark.sparkContext.broadcast(tokenizer.to_str())
    registry = ModelRegistry()
    registry.register("tokenizer", lambda device: Tokenizer.from_str(text.value))
    examples = examples.select(*keys, "words", "bboxes", "ner_tags")
    made = T.StructType([*(examples.schema[k] for k in keys), *T._parse_datatype_string(f"window int, {FEATURES}").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list[int]] = {}
        for whole in batches:
            # as many examples at once as give about so many tokens, by one window each
            for at in range(0, whole.num_rows, step := max(1, TOKENS // rules.length)):
                batch = whole.slice(at, step)
                if len(known) > KNOWN_WORDS:
                    known.clear()
                learn_words(registry.get("tokenizer"), pc.fill_null(batch.column("words").flatten(), "").unique().to_pylist(), known)
                example, columns = windows(batch, known, rules, stride, overflow)
                yield pa.RecordBatch.from_pydict({**{k: batch.column(k).take(pa.array(example)) for k in keys}, **columns})

    return examples.mapInArrow(run, made)
