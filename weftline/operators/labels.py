"""Full-context labels of sentences from tokens with syllables, stress and phonemes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weftline.functions.predicates import is_label_token, is_punct, is_quote
from weftline.operators.dealing import spread

SENT = ["doc_id", "sent_id"]
#: The token put behind every sentence, whatever it ends with.
STOP = {"word": ".", "punct": True, "quote": False, "size": 1, "stress": [0], "phones": [["pau"]]}
#: Labels to a batch, and sentences that are unpacked together.
LABELS, SENTENCES = 16_384, 128


def full_labels(tokens: DataFrame) -> DataFrame:
    """doc_id, sent_id, phone_no, label.

    tokens: doc_id, sent_id, pos, word, syllables (array), stress (array of 0 and 1), phones (an array of phonemes for each
    syllable; phonemes may hold dots and hyphens, see phones_of). Quotes toggle a state and make no label.
    """
    parts = F.struct("pos", "word", "syllables", "stress", "phones")
    return sentence_labels(spread(tokens, *SENT).groupBy(*SENT).agg(F.array_sort(F.collect_list(parts)).alias("tokens")))


def sentence_labels(sentences: DataFrame) -> DataFrame:
    """The same of doc_id, sent_id, tokens: a row for each sentence, an array of structs of word, syllables, stress and phones in order.

    A sentence is walked once, so the work is linear in its length, and nothing is shuffled.
    """
    said = F.filter("tokens", lambda t: is_label_token(t["word"]) | is_quote(t["word"]))
    kept = F.transform(said, lambda t: F.struct(t["word"].alias("word"), is_punct(t["word"]).alias("punct"), is_quote(t["word"]).alias("quote"), F.coalesce(F.size(t["syllables"]), F.lit(0)).alias("size"), t["stress"].alias("stress"), t["phones"].alias("phones")))
    # An empty sentence is left out in the function: a filter would be pushed down, and tokens be made twice.
    rows = sentences.select(*SENT, F.size("tokens").alias("n"), kept.alias("tokens"))
    schema = T.StructType([*(rows.schema[c] for c in SENT), T.StructField("phone_no", T.IntegerType()), T.StructField("label", T.StringType())])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, SENTENCES):
                for doc, sent, n, tokens in unpacked(batch.slice(at, SENTENCES)):
                    if n <= 0:
                        continue
                    made += ((doc, sent, i, label) for i, label in enumerate(labels_of([*tokens, STOP])))
                    if len(made) >= LABELS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), kinds, strict=True)], schema=kinds)
                        made = []
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), kinds, strict=True)], schema=kinds)

    return rows.mapInArrow(run, schema)


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple]:
    """doc_id, sent_id, n and tokens of a batch's rows; what is nested is taken apart by whole columns, as value by value is slow."""

    def cut(column: pa.ListArray, values: list) -> list[list]:
        ends = np.cumsum(pc.fill_null(column.value_lengths(), 0).to_numpy(zero_copy_only=False)).tolist()
        return [values[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    plain = lambda column: column.to_numpy(zero_copy_only=False).tolist()
    doc, sent, n, tokens = (batch.column(c) for c in (*SENT, "n", "tokens"))
    names = [f.name for f in tokens.type.value_type]
    of = dict(zip(names, tokens.flatten().flatten(), strict=True))
    inner = of["phones"].flatten()
    nested = {"stress": cut(of["stress"], of["stress"].flatten().to_pylist()), "phones": cut(of["phones"], cut(inner, plain(inner.flatten())))}
    columns = [nested[c] if c in nested else plain(of[c]) for c in names]
    held = [dict(zip(names, values, strict=True)) for values in zip(*columns, strict=True)]
    return zip(doc.to_pylist(), sent.to_pylist(), plain(n), cut(tokens, held), strict=True)


def labels_of(tokens: list[dict]) -> list[str]:
    """The labels of a sentence's phones, one after the other."""
    spoken, quoted = [], 0
    for t in tokens:
        quoted ^= t["quote"]
        if not t["quote"]:
            spoken.append((t, quoted))
    kind = next(({"?": "q", "!": "e"}[t["word"]] for t, _ in spoken if t["word"] in ("?", "!")), "s")
    sizes = [0 if t["punct"] else t["size"] for t, _ in spoken]
    stressed = sum(sum(t["stress"]) for t, _ in spoken if not t["punct"])
    total = sum(sizes)
    # From the end: the kind, number and syllables up to it of the mark behind each token.
    behind, after, run = [], ("sent_start", len(spoken) + 1, total), total
    for row in range(len(spoken), 0, -1):
        behind.append(after)
        if spoken[row - 1][0]["punct"]:
            after = spoken[row - 1][0]["word"], row, run
        run -= sizes[row - 1]
    behind.reverse()
    # Syllables by span, from a mark's neighbour on up to the next mark: fields of their phones but for distances to stress.
    phones, place, spans, before, run = [], [], [[]], ("sent_start", 0, 0), 0
    for row, ((t, quote), size, (next_kind, next_row, next_sum)) in enumerate(zip(spoken, sizes, behind, strict=True), 1):
        run += size
        n = max(size, 1)
        around = f"/PREVMARK:{before[0]}/PREVWORDS:{row - before[1]}/PREVSYL:{run - before[2]}/NEXTMARK:{next_kind}/NEXTWORDS:{next_row - row}/NEXTSYL:{next_sum - run}/QUOTE:{quote}/TYPE:{kind}/TWORDS:{len(spoken)}/TSYL:{total}/TSTRESS:{stressed}"
        columns = t["stress"], t["phones"]
        for syl in range(max(t["size"], *map(len, columns))):
            stress, said = (c[syl] if syl < len(c) else None for c in columns)
            own = [x for p in said or () if p is not None and p != "-" for x in p.split(".")]
            spans[-1].append(stress == 1)
            at = "single" if n == 1 else "start" if syl == 0 else "end" if syl == n - 1 else "mid"
            place += ((f"/SYLPOS:{at}/PHPOS:{k}/NPIS:{len(own)}/STRESS:{'' if stress is None else stress}", len(spans) - 1, len(spans[-1]) - 1, around) for k in range(1, len(own) + 1))
            phones += own
        if t["punct"]:
            before = t["word"], row, run
            spans.append([])
    gaps = [list(zip(to_stress(s), to_stress(s[::-1])[::-1], strict=True)) for s in spans]
    beside = ["#", "#", *phones, "#", "#"]
    out = []
    for i, (head, span, syl, around) in enumerate(place):
        two, one = ("#", "pau") if i == 0 else ("pau", beside[i + 1]) if i == 1 else (beside[i], beside[i + 1])
        back, onward = gaps[span][syl]
        out.append(f"{two}^{one}-{phones[i]}+{beside[i + 3]}={beside[i + 4]}{head}/PREVSTRESS:{back}/NEXTSTRESS:{onward}{around}")
    return out


def to_stress(flags: list[bool]) -> list[int]:
    """Steps back to the last flag, the place itself counting as 0; -1 for none."""
    out, last = [], None
    for i, flag in enumerate(flags):
        last = i if flag else last
        out.append(-1 if last is None else i - last)
    return out
