"""Statements and expressions of the dialect."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Literal:
    value: object

    def __str__(self) -> str:
        if self.value is None:
            return "NULL"
        if isinstance(self.value, bool):
            return "true" if self.value else "false"
        if isinstance(self.value, str):
            return "'" + self.value.replace("'", "''") + "'"
        return repr(self.value)


@dataclass(frozen=True)
class ColumnRef:
    name: str
    table: str | None = None

    def __str__(self) -> str:
        return self.name


@dataclass(frozen=True)
class Star:
    def __str__(self) -> str:
        return "*"


@dataclass(frozen=True)
class Binary:
    op: str  # + - * / = != < <= > >= AND OR LIKE
    left: object
    right: object

    def __str__(self) -> str:
        return f"({self.left} {self.op} {self.right})"


@dataclass(frozen=True)
class Unary:
    op: str  # NOT -
    operand: object

    def __str__(self) -> str:
        return f"NOT {self.operand}" if self.op == "NOT" else f"-{self.operand}"


@dataclass(frozen=True)
class Call:
    name: str  # lower case
    args: tuple
    distinct: bool = False

    def __str__(self) -> str:
        return f"{self.name}({'DISTINCT ' if self.distinct else ''}{', '.join(map(str, self.args))})"


@dataclass(frozen=True)
class Item:
    expr: object
    alias: str | None = None


@dataclass(frozen=True)
class Order:
    expr: object
    ascending: bool = True


@dataclass
class Select:
    items: list[Item]
    table: str | None = None
    table_alias: str | None = None
    where: object = None
    group_by: list = field(default_factory=list)
    having: object = None
    order_by: list[Order] = field(default_factory=list)
    limit: int | None = None
    offset: int = 0
    distinct: bool = False


@dataclass
class Insert:
    table: str
    columns: list[str]
    rows: list[list]


@dataclass
class Update:
    table: str
    assignments: list[tuple[str, object]]
    where: object = None


@dataclass
class Delete:
    table: str
    where: object = None


@dataclass
class CreateTable:
    table: str
    columns: list  # ColumnDef
    primary_key: list[str]
    if_not_exists: bool = False
    engine: str = "lsm"


@dataclass
class DropTable:
    table: str
    if_exists: bool = False


@dataclass
class ShowTables:
    pass


@dataclass
class Describe:
    table: str


@dataclass
class Explain:
    select: Select
