"""What no built-in function can do, as Arrow-batched pandas functions: similarity ratios, placeholders, the generator seam."""

from __future__ import annotations

import difflib
import re
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Placeholder codes of inline elements.
CODES = {
    "a": "A",
    "b": "B",
    "br": "BR",
    "div": "DIV",
    "em": "EM",
    "hr": "HR",
    "i": "I",
    "img": "IMG",
    "ruby": "RUBY",
    "s": "S",
    "span": "SPAN",
    "strong": "B",
    "table": "TABLE",
    "u": "U",
}
#: Elements without content.
VOID = ("br", "hr", "img")
DEEPEST = 3


@F.pandas_udf(T.DoubleType())
def fidelity(expected: pd.Series, actual: pd.Series) -> pd.Series:
    """difflib ratio, four places; 0 if either text is empty."""
    return pd.Series([round(difflib.SequenceMatcher(None, a, b).ratio(), 4) if a and b else 0.0 for a, b in zip(expected, actual, strict=True)])


def to_placeholders(fragment: str) -> tuple[str, dict[str, str]]:
    """(text with placeholders, placeholder -> opening tag) of a well-formed fragment. Every element with a code is counted;
    those nested deeper than DEEPEST in such elements have no placeholder in the text, void ones no closing. Other elements
    leave their text only. Malformed text stays as it is."""
    try:
        root = ET.fromstring(f"<x>{fragment}</x>")
    except ET.ParseError:
        return fragment, {}
    counts: dict[str, int] = {}
    tags: dict[str, str] = {}

    def walk(node: ET.Element, depth: int) -> str:
        out = [node.text or ""]
        for child in node:
            tag = child.tag.rsplit("}", 1)[-1].lower()
            if tag not in CODES:
                out.append(walk(child, depth))
            else:
                counts[CODES[tag]] = counts.get(CODES[tag], 0) + 1
                name = f"{CODES[tag]}_{counts[CODES[tag]]}"
                attributes = "".join(f' {k}="{v}"' for k, v in child.attrib.items())
                tags[name] = f"<{tag}{attributes}{' /' if tag in VOID else ''}>"
                shown = depth < DEEPEST
                out.append(f"⟦{name}⟧" if shown else "")
                if tag not in VOID:
                    out += [walk(child, depth + 1), f"⟦/{name}⟧" if shown else ""]
            out.append(child.tail or "")
        return "".join(out)

    return walk(root, 0), tags


def _closing(opening: str) -> str:
    return "</" + re.match(r"<([^\s/>]+)", opening).group(1) + ">"


def from_placeholders(text: str, tags: dict[str, str]) -> tuple[str, list[str]]:
    """(markup, warnings): a stack closes what is open. An unknown placeholder stays in the text, a closing that nothing
    opened becomes a closing tag, what is left open is closed; each is reported."""
    out, stack, warnings, at = [], [], [], 0
    for m in re.finditer(r"⟦(/?)([A-Z]+_\d+)⟧", text):
        out.append(text[at : m.start()])
        at = m.end()
        closing, name = m.group(1) == "/", m.group(2)
        if name not in tags:
            warnings.append(f"Unknown placeholder {name}")
            out.append(m.group())
        elif not closing:
            if not tags[name].endswith("/>"):
                stack.append(name)
            out.append(tags[name])
        elif name not in stack:
            warnings.append(f"Unexpected closing {name}")
            out.append(_closing(tags[name]))
        else:
            while True:
                top = stack.pop()
                out.append(_closing(tags[top]))
                if top == name:
                    break
                warnings.append(f"Dangling opening {top}")
    out.append(text[at:])
    for top in reversed(stack):
        warnings.append(f"Dangling opening {top}")
        out.append(_closing(tags[top]))
    return "".join(out), warnings


PLACED = T.StructType([T.StructField("text", T.StringType()), T.StructField("tags", T.MapType(T.StringType(), T.StringType()))])


@F.pandas_udf(PLACED)
def extract_placeholders(fragments: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([to_placeholders(f or "") for f in fragments], columns=["text", "tags"])


@F.pandas_udf(T.StringType())
def restore_placeholders(texts: pd.Series, tags: pd.Series) -> pd.Series:
    return pd.Series([from_placeholders(t or "", dict(g or {}))[0] for t, g in zip(texts, tags, strict=True)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def restore_warnings(texts: pd.Series, tags: pd.Series) -> pd.Series:
    """What restoring a text reports: a block with any of it is not to be published."""
    return pd.Series([from_placeholders(t or "", dict(g or {}))[1] for t, g in zip(texts, tags, strict=True)])


def generator(make_client: Callable[[], Callable[[str], str]], retries: int = 2):
    """The seam for a text model: one client a Python worker, retried; the default client of the tests is deterministic.
    Filters belong before it: Catalyst moves none below a function that is not deterministic."""

    @F.pandas_udf(T.StringType())
    def generate(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        client = make_client()

        def call(prompt: str) -> str:
            for attempt in range(retries + 1):
                try:
                    return client(prompt)
                except Exception:
                    if attempt == retries:
                        raise
            return ""

        for prompts in batches:
            yield prompts.map(call)

    return generate.asNondeterministic()
