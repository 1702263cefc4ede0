"""Rule sets for scientific HTML as LaTeXML writes it, naming styles of replaced nodes, and normal forms of targets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.operators import dom

#: Stands for a line break until white space is normalised.
BREAK = "\ue000"
_GONE = "authors bibliography classification dates note_mark page_footer role_affiliationtext role_institutetext tag_equation tag_section tag_subsection"
_NAMED = {"cite": "ltx cite", "equation": "math equation", "equationgroup": "math group", "ref": "ltx ref", "ref_tag": "ltx ref"}


def hyphenated(category: str) -> str:
    return category.replace(" ", "-")


def camel(category: str) -> str:
    return "".join(w[:1].upper() + w[1:] for w in category.split(" "))


def capitals(category: str) -> str:
    return category.upper().replace(" ", "")


def stem_rules(style: Callable[[str], str] = camel, numbered: bool = True, decorated: bool = True, titles: bool = True, breaks: bool = True, spaced: bool = False) -> dom.Rules:
    """Formulas, citations and references become tokens, apparatus goes, and breaks follow titles and paragraphs.

    ``decorated`` puts a token between @ signs, ``numbered`` counts it within its category, ``spaced`` puts spaces around it.
    """
    edge, gap = "@" * decorated, " " * spaced

    def token(category: str) -> str:
        return gap + edge + style(category) + (":{n}" if numbered else "") + edge + gap

    tags = {"math": token("math node"), **dict.fromkeys(("figure", "head", "script"))}
    classes: dict[str, str | None] = {f"ltx_{name}": token(category) for name, category in _NAMED.items()}
    classes |= dict.fromkeys(f"ltx_{name}" for name in _GONE.split())
    classes["ar5iv-footer"] = None
    if not titles:
        classes["ltx_title"] = None
    after = (("ltx_para", BREAK), ("ltx_title", BREAK)) if breaks else ()
    return dom.Rules(tuple(sorted(tags.items(), key=lambda x: x[0])), tuple(sorted(classes.items(), key=lambda x: x[0])), after)


STANDARD = stem_rules()
UNNUMBERED = stem_rules(numbered=False, decorated=False)
FAST = stem_rules(breaks=False)
SIMPLE = stem_rules(numbered=False, decorated=False, breaks=False)


def normalized(text: Column) -> Column:
    """Each run of white space becomes a line break where it holds one of the breaks that rules put there, else a space."""
    marked = F.regexp_replace(text, f"(?U)\\s*{BREAK}[\\s{BREAK}]*", BREAK)
    return F.replace(F.regexp_replace(marked, r"(?U)\s+", " "), F.lit(BREAK), F.lit("\n"))


def targets(df: DataFrame, key: str, html: str) -> DataFrame:
    """Targets in both forms: rows (key, html, start_path, end_path, start, end) get the offsets of their paths, or paths of their offsets.

    Paths come first where both are given.  A target that its document doesn't have gets an ``error`` instead of a range.
    """
    from pyspark.sql.types import StructType, _parse_datatype_string

    fields = StructType([df.schema[key], *_parse_datatype_string("start_path string, end_path string, start int, `end` int, error string").fields])

    def made(batches):
        import pyarrow as pa

        for batch in batches:
            rows, last, root = [], None, None
            for k, text, p, q, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                if text != last:
                    last, root = text, dom.parse(text)
                try:
                    if root is None:
                        raise ValueError("no document")
                    if p is not None and q is not None:
                        a, b = dom.offset_of_path(root, p), dom.offset_of_path(root, q)
                    rows.append((k, dom.path_of_offset(root, a), dom.path_of_offset(root, b), a, b, None))
                except (ValueError, TypeError) as e:
                    rows.append((k, None, None, None, None, str(e)))
            types = [batch.schema.types[0], pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, types)], fields.names)

    # one document's targets side by side, so that it is parsed once
    own = df.select(key, html, "start_path", "end_path", F.col("start").cast("int"), F.col("end").cast("int"))
    return own.repartition(F.col(key)).sortWithinPartitions(key).mapInArrow(made, fields)
