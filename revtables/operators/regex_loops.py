"""Loops of a regular expression for which the matcher takes stack in every round."""

from __future__ import annotations

from dataclasses import dataclass, field

#: Fewer rounds than this are no danger.
MANY_ROUNDS = 100
UNBOUNDED = 1 << 31


@dataclass
class _Reader:
    """One pass over an expression; ``loops`` gets the loops that take stack."""

    text: str
    at: int = 0
    loops: list[str] = field(default_factory=list)

    def ahead(self, sign: str) -> bool:
        return self.text.startswith(sign, self.at)

    def alternatives(self) -> bool:
        """Read up to the end of the group; whether all it matches has one form and length."""
        fixed, branches = self.sequence(), 1
        while self.ahead("|"):
            self.at += 1
            fixed, branches = self.sequence() and fixed, branches + 1
        return fixed and branches == 1

    def sequence(self) -> bool:
        fixed = True
        while self.at < len(self.text) and self.text[self.at] not in "|)":
            start = self.at
            is_group = self.ahead("(")
            body_fixed = self.group() if is_group else self.character()
            least, most, possessive = self.repeat()
            if is_group and most >= MANY_ROUNDS and not body_fixed and not possessive:
                self.loops.append(self.text[start : self.at])
            fixed = fixed and body_fixed and least == most
        return fixed

    def group(self) -> bool:
        self.at += 1
        looks = False
        if self.ahead("?"):
            for opening in ("?:", "?=", "?!", "?<=", "?<!", "?>"):
                if self.ahead(opening):
                    self.at += len(opening)
                    looks = opening[-1] in "=!"
                    break
            else:
                if self.ahead("?<"):
                    self.at = self._after(">")
                else:
                    while self.at < len(self.text) and self.text[self.at] not in ":)":
                        self.at += 1
                    if self.ahead(")"):  # flags for what follows; no group
                        self.at += 1
                        return True
                    self.at += 1
        fixed = self.alternatives()
        self.at = min(self.at + 1, len(self.text))
        return fixed or looks  # what is looked at has no length

    def _after(self, sign: str) -> int:
        end = self.text.find(sign, self.at)
        return len(self.text) if end < 0 else end + len(sign)

    def character(self) -> bool:
        if self.ahead("\\Q"):
            self.at = self._after("\\E")
        elif self.ahead("\\"):
            kind = self.text[self.at + 1 : self.at + 2]
            self.at += 2
            if kind in tuple("pPxkN") and self.at < len(self.text) and self.text[self.at] in "{<":
                self.at = self._after("}" if self.text[self.at] == "{" else ">")
            # a reference has the length of what it refers to, line ends have one or two characters
            return kind not in tuple("kRX123456789")
        elif self.ahead("["):
            self.set()
        else:
            self.at += 1
        return True

    def set(self) -> None:
        """Read a set of characters, which may hold others."""
        self.at += 1
        if self.ahead("^"):
            self.at += 1
        first = True
        while self.at < len(self.text):
            if self.ahead("\\Q"):
                self.at = self._after("\\E")
            elif self.ahead("\\"):
                self.at += 2
            elif self.ahead("["):
                self.set()
            elif self.ahead("]") and not first:
                self.at += 1
                return
            else:
                self.at += 1
            first = False

    def repeat(self) -> tuple[int, int, bool]:
        """Least and most rounds, and whether the loop gives nothing back."""
        sign = self.text[self.at : self.at + 1]
        if sign and sign in "*+?":
            least, most = {"*": (0, UNBOUNDED), "+": (1, UNBOUNDED), "?": (0, 1)}[sign]
            self.at += 1
        elif sign == "{":
            end = self._after("}")
            low, _, high = self.text[self.at + 1 : end - 1].partition(",")
            least = int(low or 0)
            most = least if "," not in self.text[self.at : end] else int(high or UNBOUNDED)
            self.at = end
        else:
            return 1, 1, False
        possessive = self.ahead("+")
        self.at += possessive or self.ahead("?")
        return least, most, possessive


def open_loops(regex: str) -> list[str]:
    """The repeated groups that are neither possessive nor of one fixed form, inner ones first.

    The matcher goes one call deeper for every round of such a loop, so a long text ends
    the executor: a group with alternatives or with anything in it whose length varies,
    however deep. Loops over single characters and over groups that always match the same
    number of characters in one way take no stack.
    """
    reader = _Reader(regex)
    while reader.at < len(regex):
        reader.alternatives()
        reader.at += 1  # a bracket that closes nothing
    return reader.loops
