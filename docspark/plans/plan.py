"""The conversion plan: which inputs go to which outputs, and which options fit."""

from __future__ import annotations

from dataclasses import dataclass, field

INPUTS = ("xlsx", "docx", "pptx", "csv", "tsv")
OUTPUTS = ("csv", "tsv", "json", "markdown", "pdf")
ALIASES = {"md": "markdown"}
#: Outputs of each input.
MATRIX = {
    "xlsx": ("csv", "tsv", "json", "markdown"),
    "docx": ("markdown", "pdf"),
    "pptx": ("markdown", "pdf"),
    "csv": ("csv", "tsv", "json", "markdown"),
    "tsv": ("csv", "tsv", "json", "markdown"),
}
#: Error classes and their exit codes.
CODES = {"arguments": 2, "usage": 64, "data": 65, "no_input": 66, "io": 74}


class ConvertError(Exception):
    """A failure with its class; in a corpus job it is a row of errors, never an exception of the job."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind, self.message, self.code = kind, message, CODES[kind]


@dataclass(frozen=True)
class Options:
    to: str
    from_: str | None = None
    sheet: str | None = None
    all_sheets: bool = False
    typed: bool = False
    no_notes: bool = False
    images: str | None = None
    output: str | None = None
    terminal: bool = False


@dataclass(frozen=True)
class Plan:
    kind: str
    to: str
    options: Options
    model: str = field(default="table")


def output_format(name: str) -> str:
    name = ALIASES.get(name, name)
    if name not in OUTPUTS:
        raise ConvertError("arguments", f"unknown output format {name!r}; one of {', '.join(OUTPUTS)}")
    return name


def check_options(options: Options) -> None:
    """What can be said before the input is opened."""
    if options.sheet is not None and options.all_sheets:
        raise ConvertError("arguments", "one sheet and all sheets cannot both be asked for")
    if options.typed and output_format(options.to) != "json":
        raise ConvertError("usage", "typed values need JSON output")


def expected_inputs(to: str) -> list[str]:
    return [kind for kind, outputs in MATRIX.items() if to in outputs]


def plan(kind: str, options: Options) -> Plan:
    """The plan for an input of this kind, or the first rule that it breaks."""
    check_options(options)
    to = output_format(options.to)
    if to not in MATRIX[kind]:
        raise ConvertError("usage", f"{kind} converts to {', '.join(MATRIX[kind])}, not {to}; {to} comes from {', '.join(expected_inputs(to))}")
    if (options.sheet is not None or options.all_sheets) and kind != "xlsx":
        raise ConvertError("usage", f"{kind} has no sheets to choose from")
    if options.no_notes and kind != "pptx":
        raise ConvertError("usage", f"{kind} has no speaker notes")
    if kind in ("csv", "tsv") and (options.typed or options.images is not None):
        raise ConvertError("usage", f"{kind} has neither typed values nor images")
    if options.images is not None and to == "pdf":
        raise ConvertError("usage", "images of a PDF are inside it")
    if to == "pdf" and options.output is None and options.terminal:
        raise ConvertError("usage", "a PDF is not written to a terminal")
    return Plan(kind, to, options, "document" if kind in ("docx", "pptx") else "table")


def matrix_rows() -> list[tuple[str, str, bool]]:
    return [(kind, to, to in MATRIX[kind]) for kind in INPUTS for to in OUTPUTS]
