"""Which elements of a page are visible: style sheets' and elements' own declarations of display and visibility, the latter inherited."""

import re
from collections.abc import Iterator

#: A rule's selector of one element: a tag or *, then classes and ids.
COMPOUND = re.compile(r"(\*|[a-z][\w-]*)?((?:[.#][\w-]+)*)\Z", re.I)
COMMENT, NESTED = re.compile(r"/\*.*?(?:\*/|\Z)", re.S), re.compile(r"\"[^\"]*\"|'[^']*'|\([^()]*\)")
SCREEN = frozenset({"@media", "@media all", "@media screen"})
Declared = dict[str, tuple[str, bool]]


def declarations(style: str) -> Declared:
    """Values of display and visibility, and whether they are important; the last of each counts, important ones first. Strings and what stands in brackets are no declarations."""
    out: Declared = {}
    if "display" not in (low := style.lower()) and "visibility" not in low:
        return out
    for part in NESTED.sub("", low).split(";"):
        name, _, value = part.partition(":")
        name, value = name.strip(), value.strip()
        if name in ("display", "visibility") and value:
            important = value.endswith("!important")
            if important or not out.get(name, ("", False))[1]:
                out[name] = value.removesuffix("!important").strip(), important
    return out


def _blocks(sheet: str) -> Iterator[tuple[str, str]]:
    """Selectors and declarations of the rules that hold on a screen, in order."""
    open_, prelude, skipped = [], "", 0
    for piece in re.split(r"([{}])", COMMENT.sub("", sheet)):
        if piece == "{":
            open_.append(prelude)
            skipped += prelude.startswith("@") and prelude not in SCREEN
            prelude = ""
        elif piece == "}":
            if open_:
                head = open_.pop()
                skipped -= head.startswith("@") and head not in SCREEN
                if not skipped and not head.startswith("@"):
                    yield head, prelude
            prelude = ""
        elif open_ and not open_[-1].startswith("@"):
            prelude = piece
        else:
            prelude = " ".join(piece.rpartition(";")[2].split()).lower() if "@" in piece else piece.rpartition(";")[2].strip()


class Sheet:
    """Rules for display and visibility by tag, class and id. Selectors of an element by others around it, by attributes or states hold for nothing."""

    def __init__(self, sheets: list[str]) -> None:
        found: dict[tuple[str, tuple[str, ...]], dict[str, tuple[bool, tuple[int, int, int], int, str]]] = {}
        place = 0
        for text in sheets:
            for heads, body in _blocks(text):
                own = declarations(body)
                for head in heads.split(",") if own else ():
                    m = COMPOUND.match(head.strip())
                    if not m or not m[0]:
                        continue
                    tag, marks = (m[1] or "*").lower(), tuple(sorted(set(re.findall(r"[.#][\w-]+", m[2]))))
                    rank = sum(x[0] == "#" for x in marks), sum(x[0] == "." for x in marks), int(tag != "*")
                    into = found.setdefault((tag, marks), {})
                    for name, (value, important) in own.items():
                        place += 1
                        into[name] = max(into.get(name, (False, (0, 0, 0), 0, "")), (important, rank, place, value))
        self.by: dict[str, list] = {}
        for (tag, marks), own in found.items():
            self.by.setdefault(marks[0] if marks else tag, []).append((tag, frozenset(marks), own))
        self.known: dict[tuple[str, frozenset[str]], dict] = {}

    def of(self, tag: str, a: dict[str, str]) -> Declared:
        """What the rules and the element's own style declare."""
        marks = frozenset([*("." + x for x in a.get("class", "").split()), *(["#" + a["id"]] if a.get("id") else [])]) if a else frozenset()
        best = self.known.get((tag, marks))
        if best is None:
            best = self.known[tag, marks] = {}
            for key in (tag, "*", *marks):
                for t, need, own in self.by.get(key, ()):
                    if t in ("*", tag) and need <= marks:
                        for name, x in own.items():
                            best[name] = max(best.get(name, x), x)
        out = {name: (x[3], x[0]) for name, x in best.items()}
        for name, (value, important) in declarations(a["style"]).items() if a.get("style") else ():
            if important or not out.get(name, ("", False))[1]:
                out[name] = value, important
        return out
