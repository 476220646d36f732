"""The query language: required, optional and excluded words, phrases."""

from __future__ import annotations

from pyspark.sql import types as ty
from pyspark.sql.functions import udtf

REQUIRED, OPTIONAL, EXCLUDED, PHRASE = "required", "optional", "excluded", "phrase"
Term = tuple[str, str]


def parse_query(query: str) -> list[Term]:
    """(kind, text) of each term, in order.

    Spaces part words. AND is dropped, OR makes the required word before it optional, NOT or a leading
    hyphen excludes the word that follows. A closing quote yields the phrase without its last word,
    which goes on as an ordinary word; phrases bear no meaning in scoring. An unclosed quote drops its last word.
    """
    found: list[Term] = []
    phrase: list[str] = []
    state = {"word": "", "quoted": False, "minus": False}

    def settle() -> None:
        word, state["word"] = state["word"].strip(), ""
        if not word:
            return
        upper = word.upper()
        if upper == "OR":
            if found and found[-1][0] == REQUIRED:
                found[-1] = (OPTIONAL, found[-1][1])
        elif upper == "NOT":
            state["minus"] = True
        elif upper != "AND":
            found.append((EXCLUDED if state["minus"] else REQUIRED, word))
            state["minus"] = False

    for c in query:
        if c == '"':
            if state["quoted"]:
                if phrase:
                    found.append((PHRASE, " ".join(phrase)))
                    phrase = []
            elif state["word"]:
                found.append((EXCLUDED if state["minus"] else REQUIRED, state["word"]))
                state["word"], state["minus"] = "", False
            state["quoted"] = not state["quoted"]
        elif c == " " and state["quoted"]:
            if state["word"]:
                phrase.append(state["word"])
                state["word"] = ""
        elif c == " ":
            settle()
        elif c == "-" and not state["word"] and not state["quoted"]:
            state["minus"] = True
        else:
            state["word"] += c
    if state["quoted"] and phrase:
        found.append((PHRASE, " ".join(phrase)))
    else:
        last = state["word"].strip()
        if last and last.upper() not in ("OR", "AND"):
            found.append((EXCLUDED if state["minus"] else REQUIRED, last))
    return found


@udtf(returnType=ty.StructType([ty.StructField("pos", ty.IntegerType()), ty.StructField("kind", ty.StringType()), ty.StructField("text", ty.StringType())]))
class ParseQuery:
    """Table function: one row per term of a query."""

    def eval(self, query: str):
        for i, (kind, text) in enumerate(parse_query(query or "")):
            yield i, kind, text
