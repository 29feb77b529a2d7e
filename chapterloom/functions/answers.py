"""Cleaning of model answers and of free-form stamps, as Column expressions; prompt templates for the driver."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Labels that answers repeat.
LABELS = ("Category", "Translation", "Term", "Evidence", "Output", "Result")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def without_fence(answer: Column) -> Column:
    """The inside of a fenced block, or the answer itself."""
    bare = strip(answer)
    return F.when(bare.startswith("```"), strip(F.regexp_replace(F.regexp_replace(bare, r"^```[^\n]*(\n|$)", ""), r"(^|\n)\s*```\s*$", ""))).otherwise(bare)


def last_line(answer: Column) -> Column:
    """The last line with something on it, labels taken off the beginnings of lines; "" if there is none."""
    bare = F.regexp_replace(strip(answer), r"(?im)^(?:" + "|".join(LABELS) + r")\s*:\s*", "")
    lines = F.filter(F.transform(F.split(bare, r"\R"), strip), lambda x: x != "")
    return F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit(""))


def without_echo(answer: Column, source: Column) -> Column:
    """What follows the last repetition of the source, else the answer."""
    quoted = F.replace(source, F.lit("\\E"), F.lit("\\E\\\\E\\Q"))  # an end of quoting in the source is quoted too
    parts = F.split(answer, F.concat(F.lit(r"\Q"), quoted, F.lit(r"\E")), -1)
    return F.when((source != "") & (F.size(parts) > 1), strip(F.element_at(parts, -1))).otherwise(answer)


def instant(stamp: Column) -> Column:
    """Microseconds of an ISO stamp: `Z` or an offset, else UTC; null if blank or unreadable."""
    bare = F.nullif(F.trim(stamp), F.lit(""))
    return F.unix_micros(F.try_to_timestamp(bare))


@dataclass(frozen=True)
class Prompt:
    version: str
    template: str

    @staticmethod
    def parse(content: str) -> Prompt:
        """A template whose first line is `# version: X`."""
        head, _, body = content.partition("\n")
        mark = "# version:"
        version = head.strip()[len(mark) :].strip()
        if not head.strip().lower().startswith(mark) or not version:
            raise ValueError("a prompt starts with '# version: X'")
        return Prompt(version, body.lstrip("\n"))

    def fill(self, **sections: Column) -> Column:
        """The template with its {names} replaced by columns."""
        out = F.lit(self.template)
        for name, value in sections.items():
            out = F.replace(out, F.lit("{" + name + "}"), value)
        return out
