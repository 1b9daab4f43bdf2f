r"""One grammar of html's tokens, as text that Java's and Python's regular expressions read alike.

A page is a row of tokens: comments, end tags and declarations, and start tags, each with the body behind it that is no markup where its
element has one (a script, a style, a text field, a title). A token that the page's end cuts off goes on to the end, so whatever
stands in a page, each of its characters is looked at a bounded number of times. Attributes are separated as in the html standard: quotes
count only where a value begins, and of two equal names the first one counts.
"""

from __future__ import annotations

SPACE = r"[ \t\n\f\r]"
#: Where a page ends.
END = r"(?![\s\S])"
#: Elements whose body is text.
RAW = ["script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp"]

NAME = r"[A-Za-z][^ \t\n\f\r/>]*+"
VALUE = rf"\"[^\"]*+(?:\"|{END})|'[^']*+(?:'|{END})|[^ \t\n\f\r>\"'][^ \t\n\f\r>]*+"
#: An attribute: its name, and its value if it has one.
ATTR = rf"[^ \t\n\f\r/>][^ \t\n\f\r/>=]*+(?:{SPACE}*+={SPACE}*+(?:{VALUE})?+)?+"
ATTRS = rf"(?:[ \t\n\f\r/]++|{ATTR})*+"
COMMENT = rf"<!--(?:-?>|[\s\S]*?(?:--!?>|{END}))"
#: What begins like a tag and is none that opens an element.
OTHER = rf"</{NAME}{ATTRS}(?:>|{END})|<[!?/][^>]*+(?:>|{END})"
_EDGE = rf"(?=[ \t\n\f\r/>]|{END})"


def start_tags(names: list[str] | None = None) -> str:
    """A token; group 3 is its start tag, if it has one of the wanted names (any, by default) and is whole."""
    raw = "|".join(RAW)
    wanted = NAME if names is None else f"(?:{'|'.join(names)}){_EDGE}"
    return (
        rf"{COMMENT}|{OTHER}|(?:(?=<({raw}){_EDGE}())|)(?:(<{wanted}{ATTRS}>)|<{NAME}{ATTRS}(?:>|{END}))"
        rf"(?:\2[\s\S]*?(?:(?=</\1{_EDGE})|{END}))?+"
    )


def bodies(name: str) -> str:
    """A token; group 1 is the body of an element of that name, which is one of ``RAW``."""
    others = "|".join(r for r in RAW if r != name)
    return (
        rf"{COMMENT}|{OTHER}|<{name}{_EDGE}{ATTRS}>([\s\S]*?)(?:(?=</{name}{_EDGE})|{END})"
        rf"|(?:(?=<({others}){_EDGE}())|)<{NAME}{ATTRS}(?:>|{END})(?:\3[\s\S]*?(?:(?=</\2{_EDGE})|{END}))?+"
    )
