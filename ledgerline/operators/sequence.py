"""Target sequences (T1-T11): records <-> tagged text, vocabulary, label ids.

The linearisation is generated from the declared schema: walking the
StructType once in Python yields a single Column expression tree (concat of
tags and values), evaluated in codegen like any projection. Absent (NULL)
fields are left out, as an absent key is in the JSON target.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.schema import EOS_TOKEN, FIELD_CODES, GT_SCHEMA, LITERALS, PAD_TOKEN, TASK_PROMPT

c = F.col
SEP = "<sep/>"

# Maximum target length of the format and the id of ignored label positions.
MAX_LENGTH = 1536
IGNORE_ID = -100


def _scalar(col: Column, dtype: T.DataType, categorical: list[str] | None) -> Column:
    s = col.cast("string")
    if isinstance(dtype, T.BooleanType):
        s = F.initcap(s)  # True / False, as the format prints them
    if categorical:
        tags = [f"<{x}/>" for x in categorical]
        s = F.when(F.concat(F.lit("<"), s, F.lit("/>")).isin(*tags), F.concat(F.lit("<"), s, F.lit("/>"))).otherwise(s)
    return s


def linearise(col: Column, dtype: T.DataType, sort_keys: bool = True,
              categorical: list[str] | None = None) -> Column:
    """JSON value -> tagged sequence, by schema.

    struct: <s_k>value</s_k> per non-NULL field (code-point order when
    sort_keys, else declared order); a struct whose only present field is
    ``text_sequence`` yields that text; array: items joined by <sep/>, a NULL
    item as None; scalar: its text (or <value/> when registered as categorical).
    For JSON of no known schema see ``linearise_json``.
    """
    if isinstance(dtype, T.StructType):
        fields = sorted(dtype.fields, key=lambda f: f.name) if sort_keys else dtype.fields
        parts, others = [], F.lit(True)
        for f in fields:
            value = col.getField(f.name)
            inner = linearise(value, f.dataType, sort_keys, categorical)
            parts.append(F.when(value.isNotNull(), F.concat(F.lit(f"<s_{f.name}>"), inner, F.lit(f"</s_{f.name}>"))))
            if f.name != "text_sequence":
                others = others & value.isNull()
        tagged = F.concat_ws("", *parts) if parts else F.lit("")
        if "text_sequence" not in dtype.fieldNames():
            return tagged
        text = col.getField("text_sequence")
        return F.when(others & text.isNotNull(), text.cast("string")).otherwise(tagged)
    if isinstance(dtype, T.ArrayType):
        item = lambda x: F.when(x.isNull(), F.lit("None")).otherwise(linearise(x, dtype.elementType, sort_keys, categorical))
        return F.array_join(F.transform(col, item), SEP)
    return _scalar(col, dtype, categorical)


def _tagged(value, sort_keys: bool, categorical: frozenset) -> str:
    if isinstance(value, dict):
        if list(value) == ["text_sequence"]:
            return _tagged(value["text_sequence"], sort_keys, frozenset())
        return "".join(f"<s_{k}>{_tagged(value[k], sort_keys, categorical)}</s_{k}>" for k in (sorted(value) if sort_keys else value))
    if isinstance(value, list):
        return SEP.join(_tagged(x, sort_keys, categorical) for x in value)
    text = str(value)
    return f"<{text}/>" if text in categorical else text


def linearise_json(js: Column, sort_keys: bool = True, categorical: list[str] | None = None) -> Column:
    """T1-T3 of JSON texts without a schema: any nesting, keys in document order when not
    sorted, null as None. NULL or broken JSON gives NULL. Arrow batches; where the schema is
    known, ``linearise`` stays in the JVM."""
    known = frozenset(categorical or ())

    def one(text):
        try:
            return _tagged(json.loads(text, parse_float=str, parse_int=str), sort_keys, known)
        except (TypeError, ValueError, RecursionError):
            return None

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    return run(js)


def _untagged(seq: str, categorical: frozenset):
    """Elements become keys, <sep/> parts a list; a value without elements is its text."""
    # a frame: [name, finished items, keys of the item at hand, its text]
    stack = [["", [], {}, []]]

    def item(frame):
        text = "".join(frame[3]).strip()
        if not frame[2] and text.startswith("<") and text.endswith("/>") and text[1:-2] in categorical:
            text = text[1:-2]
        return frame[2] or text

    def value(frame):
        items = [*frame[1], item(frame)]
        return items[0] if len(items) == 1 else items

    for token in re.split(r"(</?s_[^<>]*>|<sep/>)", seq):
        if token == SEP:
            top = stack[-1]
            top[1].append(item(top))
            top[2], top[3] = {}, []
        elif token.startswith("</s_") and token.endswith(">"):
            name = token[4:-1]
            if any(f[0] == name for f in stack[1:]):
                while True:  # an element that never closes leaves its content to its parent
                    top = stack.pop()
                    if top[0] == name:
                        stack[-1][2][name] = value(top)
                        break
                    stack[-1][1] += top[1]
                    stack[-1][2].update(top[2])
                    stack[-1][3] += top[3]
        elif token.startswith("<s_") and token.endswith(">"):
            stack.append([token[3:-1], [], {}, []])
        else:
            stack[-1][3].append(token)
    while len(stack) > 1:
        top = stack.pop()
        stack[-1][1] += top[1]
        stack[-1][2].update(top[2])
        stack[-1][3] += top[3]
    out = value(stack[0])
    return {"text_sequence": out} if isinstance(out, str) else out


def parse_json(seq: Column, categorical: list[str] | None = None) -> Column:
    """T11 without a schema: tagged text -> JSON text; any tags, nested, lists as arrays;
    text without a tag is its ``text_sequence``. Arrow batches."""
    known = frozenset(categorical or ())

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: json.dumps(_untagged(t, known), ensure_ascii=False), na_action="ignore")

    return run(seq)


def target_sequence(df: DataFrame, gt: Column, schema: T.StructType = GT_SCHEMA,
                    sort_keys: bool = True, eos: bool = True) -> DataFrame:
    """T1 + T4: sequence column from a gt struct column, with the end marker."""
    seq = linearise(gt, schema, sort_keys)
    return df.withColumn("sequence", F.concat(seq, F.lit(EOS_TOKEN)) if eos else seq)


def vocabulary() -> list[str]:
    """T5: open/close tag per field code, the literal values, the task prompt."""
    toks = []
    for code in FIELD_CODES.values():
        toks += [f"<s_{code}>", f"</s_{code}>"]
    toks += list(LITERALS.values())
    toks.append(TASK_PROMPT)
    return toks


def name_vocabulary() -> list[str]:
    """T5 as the format's own vocabulary step builds it: from the logical field
    *names* (e.g. <s_pageNumber>), which the sequences never contain."""
    return [t for name in FIELD_CODES for t in (f"<s_{name}>", f"</s_{name}>")]


def vocabulary_df(spark) -> DataFrame:
    rows = [(t, i) for i, t in enumerate(vocabulary())]
    return spark.createDataFrame(rows, "token string, token_id int")


# The markers of the format that are single tokens beside the vocabulary.
UNK_TOKEN = "<unk>"
MARKERS = [SEP, EOS_TOKEN, PAD_TOKEN, UNK_TOKEN]


def label_vocabulary() -> list[str]:
    """The tokens that have an id of their own, in id order: T5's vocabulary, then the markers."""
    return vocabulary() + MARKERS


def _token_pattern() -> str:
    words = [t for t in label_vocabulary() if not t.startswith(("<s_", "</s_"))]
    fixed = "|".join(re.sub(r"([^A-Za-z0-9 _<>/])", r"\\\1", t) for t in sorted(words, key=len, reverse=True))
    return rf"</?s_[A-Za-z0-9_]+>|{fixed}|<[^<>\s]+/>|[\s\S]"


TOKEN_PATTERN = _token_pattern()


def tokens(seq: Column) -> Column:
    """Tags, markers, literals and else single characters, in order."""
    return F.regexp_extract_all(seq, F.lit(TOKEN_PATTERN), 0)


def new_tokens(used: DataFrame, vocab: DataFrame) -> DataFrame:
    """Tokens not yet in a vocabulary (left anti join)."""
    return used.join(vocab, "token", "left_anti")


def label_ids(df: DataFrame, seq: str, max_length: int = MAX_LENGTH, char_base: int = 1000) -> DataFrame:
    """``df`` with labels, n_tokens_full and truncated.

    Vocabulary tokens take their place in ``label_vocabulary``, single
    characters char_base + their code point, unknown tags the id of <unk>.
    The labels are cut at ``max_length`` (the format's setting; the cut takes
    the end marker, ``truncated`` tells) and padded with IGNORE_ID. Tokens,
    ids and padding are projections of their own, each computed once.
    """
    vocab = label_vocabulary()
    voc = F.create_map(*[x for i, t in enumerate(vocab) for x in (F.lit(t), F.lit(i))])
    unk = F.lit(vocab.index(UNK_TOKEN))
    # Single characters never need the map (vocabulary tokens are longer).
    one = lambda t: F.when(F.length(t) == 1, F.ascii(t) + F.lit(char_base)).otherwise(F.coalesce(F.try_element_at(voc, t), unk))
    df = df.withColumn("_tokens", tokens(c(seq))).withColumn("n_tokens_full", F.size("_tokens"))
    df = df.withColumn("_ids", F.transform(F.slice("_tokens", 1, max_length), one))
    pad = F.array_repeat(F.lit(IGNORE_ID), F.greatest(F.lit(0), F.lit(max_length) - F.size("_ids")))
    return df.withColumn("labels", F.concat("_ids", pad)).withColumn("truncated", c("n_tokens_full") > max_length) \
        .drop("_tokens", "_ids")


def labels_text(labels: Column) -> Column:
    """Label ids joined by commas. Where all ignored positions come last, as padding does, their text is
    repeated rather than printed one by one; any other array is printed whole."""
    ids = F.array_remove(labels, F.lit(IGNORE_ID))
    padding = F.repeat(F.lit(f",{IGNORE_ID}"), F.size(labels) - F.size(ids))
    padded = F.ltrim(F.concat(F.array_join(ids.cast("array<string>"), ","), padding), F.lit(","))
    return F.when(F.slice(labels, 1, F.size(ids)) == ids, padded).otherwise(F.array_join(labels.cast("array<string>"), ","))


def decode_ids(ids: Column, char_base: int = 1000) -> Column:
    """Label ids -> text by look-up in the vocabulary; ignored positions are left out."""
    voc = F.array(*[F.lit(t) for t in label_vocabulary()])
    one = lambda i: F.when(i >= char_base, F.char(i - F.lit(char_base))).otherwise(F.get(voc, i))
    return F.array_join(F.transform(F.filter(ids, lambda i: i >= 0), one), "")


def clean_prediction(raw: Column) -> Column:
    """T8 + T9: drop end/pad markers, the first tag, outer whitespace, and a
    space after '>' or before a closing tag."""
    s = F.replace(F.replace(raw, F.lit(EOS_TOKEN), F.lit("")), F.lit(PAD_TOKEN), F.lit(""))
    # The format's two cleanup patterns (a tag ends on its line).
    s = F.regexp_replace(s, r"^([\s\S]*?)<[^\n]*?>", "$1")
    s = F.regexp_replace(s, r"(?U)^\s+|\s+$", "")
    return F.replace(F.replace(s, F.lit("> "), F.lit(">")), F.lit(" </s_"), F.lit("</s_"))


def clean_answer(answer: Column) -> Column:
    """T10."""
    return F.replace(answer, F.lit(EOS_TOKEN), F.lit(""))


def _parsed_item(x: Column, dtype: T.DataType) -> Column:
    item = parse_sequence(x, dtype) if isinstance(dtype, T.StructType) else x.try_cast(dtype)
    return F.when(x != "None", item)


def parse_sequence(seq: Column, schema: T.StructType = GT_SCHEMA) -> Column:
    """Tagged sequence -> struct of the known schema (inverse of T1); arrays are
    split at <sep/>. Tags outside the schema are left out: ``parse_json`` keeps them.

    ``seq`` is read once per field, so pass a column (project an expression
    into a column first) rather than a large expression.
    """
    fields = []
    for f in schema.fields:
        body = F.regexp_extract(seq, f"(?s)<s_{f.name}>(.*?)</s_{f.name}>", 1)
        present = F.contains(seq, F.lit(f"<s_{f.name}>"))
        if isinstance(f.dataType, T.StructType):
            val = parse_sequence(body, f.dataType)
        elif isinstance(f.dataType, T.ArrayType):
            val = F.transform(F.split(body, SEP), lambda x: _parsed_item(x, f.dataType.elementType))
        elif isinstance(f.dataType, T.IntegerType):
            val = body.try_cast("int")
        else:
            val = body
        fields.append(F.when(present, val).alias(f.name))
    return F.struct(*fields)
