"""What sheets look like: header words, field aliases and category words, and how a header row is found and mapped."""

from __future__ import annotations

import re
import unicodedata

# Words that occur in header rows.
HEADER_WORDS = (
    "cliente", "client", "customer", "supplier", "supplier name", "mpn", "mpn quoted", "po", "qty", "quantity", "cost", "price", "total price", "gp", "gp rate", "commission", "comision", "line id", "description",
    "generic", "clean mfg", "req qty", "delivery", "delivery qto", "target to vendor", "target_to_vendor", "potential amount usd", "potential_amount_usd", "incoterm", "best price offered", "manufacturer quoted", "date code",
    "moq", "spq", "on hand", "lead time", "transit time", "earliest shipping date", "shipping point", "shipping point country", "delivery point", "comments", "manufacturer", "mfg", "warehouse", "stock", "inspection",
    "authenticity", "visual inspection", "electrical test", "product cost", "gross margin", "net profit",
)
# Names of each field, in order of priority.
FIELD_ALIASES = {
    "line_id": ["line id", "line", "line_id"],
    "client": ["client id", "client code"],
    "customer": ["customer", "cliente", "client", "sanm unico"],
    "supplier": ["supplier", "vendor"],
    "supplier_name": ["supplier name", "supplier", "vendor name"],
    "mpn": ["mpn", "part number", "part no", "part no.", "pn", "p/n", "manufacturer part number", "mfr part number", "mfg part number", "item number", "component", "clean mpn"],
    "mpn_quoted": ["mpn quoted", "quoted mpn"],
    "manufacturer": ["manufacturer", "manufacturer quoted", "mfg", "brand"],
    "clean_mfg": ["clean mfg", "clean manufacturer", "mfg clean"],
    "description": ["description", "desc"],
    "generic": ["generic", "generic category"],
    "po": ["po", "purchase order"],
    "qty": ["qty", "quantity", "qtty", "delivery qto", "qty order wks 1 13"],
    "req_qty": ["req qty", "required qty", "request qty"],
    "cost": ["cost", "unit cost", "product cost"],
    "price": ["price", "unit price", "selling price"],
    "total_price": ["total price", "total sale", "amount"],
    "gp_rate": ["gp rate", "gross profit rate", "margin rate"],
    "gp": ["gp", "gross profit"],
    "commission": ["commission", "comision"],
    "potential_amount_usd": ["potential amount usd", "potential_amount_usd", "potential amount"],
    "target_to_vendor": ["target to vendor", "target_to_vendor"],
    "best_price_offered": ["best price offered", "best price", "offered price"],
    "date_code": ["date code", "dc"],
    "moq": ["moq"],
    "spq": ["spq"],
    "on_hand": ["on hand", "stock", "inventory"],
    "lead_time_weeks": ["lead time wks", "lead time weeks", "lead time"],
    "transit_time_weeks": ["transit time wks", "transit time weeks", "transit time"],
    "earliest_shipping_date": ["earliest shipping date", "shipping date"],
    "shipping_point_country": ["shipping point country", "shipping point", "origin country"],
    "delivery_point": ["delivery point", "delivery location", "destination"],
    "comments": ["comments", "comment", "notes"],
}
# Header words of each category, in order of precedence.
CATEGORY_WORDS = {
    "Sales Margin": ["cost", "price", "total price", "gp rate", "gp", "commission", "comision"],
    "RFQ": ["line id", "req qty", "target to vendor", "potential amount usd", "qpddd", "plan item"],
    "Customer Demand": ["customer", "req qty", "plan item", "generic", "potential amount usd"],
    "Supplier Offers": ["supplier name", "best price offered", "mpn quoted", "manufacturer quoted", "date code", "moq", "spq"],
    "Logistics": ["delivery qto", "delivery next qto", "lead time", "transit time", "shipping point", "delivery point"],
    "Inventory": ["part number", "manufacturer", "qty", "stock", "warehouse", "on hand"],
    "Quality": ["inspection", "authenticity", "visual inspection", "electrical test"],
    "Finance": ["product cost", "gross margin", "net profit", "commission"],
}
#: Columns that together speak for a category, and how strongly.
CATEGORY_BONUS = (("Sales Margin", ("cost", "price", "gp_rate"), 4), ("Supplier Offers", ("best_price_offered", "mpn_quoted"), 4), ("Logistics", ("lead_time_weeks", "shipping_point_country"), 3))
NUMERIC = frozenset("qty req_qty cost price total_price gp_rate gp commission potential_amount_usd target_to_vendor best_price_offered moq spq on_hand lead_time_weeks transit_time_weeks".split())
DATES = frozenset(["earliest_shipping_date"])


def plain(text: str | None) -> str:
    """A header cell without marks, signs and case."""
    t = "".join(c for c in unicodedata.normalize("NFD", text or "") if not unicodedata.combining(c))
    return " ".join(re.sub(r"[^A-Za-z0-9\s]", "", re.sub(r"[_-]", " ", t)).lower().split())


_WORDS = sorted({plain(w) for w in HEADER_WORDS})


def header_score(cells: list[str | None]) -> tuple[int, int]:
    """(score, recognised cells) of a row taken as a header."""
    names = [p for c in cells if (p := plain(c))]
    known = sum(any(w in n for w in _WORDS) for n in names)
    return 4 * known + min(len(names), 20) - (len(names) - len(set(names))), known


def find_header(rows: list[list[str | None]]) -> tuple[int, float]:
    """Index of the first best-scoring row among the first ones, and how sure that is (0 to 1)."""
    best, at, filled = -1, 0, 1
    for i, cells in enumerate(rows):
        score, _ = header_score(cells)
        if score > best:
            best, at, filled = score, i, sum(bool(plain(c)) for c in cells)
    return at, min(1.0, max(0, best) / max(12, 3 * filled))


def unique_names(cells: list[str | None]) -> list[str]:
    """Header names: blanks numbered, repeats counted."""
    out, seen = [], {}
    for i, c in enumerate(cells, 1):
        name = (c or "").strip() or f"column_{i}"
        seen[name] = seen.get(name, 0) + 1
        out.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return out


def map_fields(names: list[str]) -> dict[str, int]:
    """Field -> column: exact names first, then names that contain an alias; a column serves one field."""
    headers = [plain(n) for n in names]
    out: dict[str, int] = {}
    for exact in (True, False):
        for name, aliases in FIELD_ALIASES.items():
            if name in out:
                continue
            wanted = [plain(a) for a in aliases]
            hit = next((i for a in wanted for i, h in enumerate(headers) if i not in out.values() and (h == a if exact else len(a) > 2 and a in h)), None)
            if hit is not None:
                out[name] = hit
    return out


def part_columns(names: list[str]) -> list[int]:
    """Columns whose header has a part number's name in it, where nothing else told the part."""
    wanted = [plain(a) for a in FIELD_ALIASES["mpn"]]
    return [i for i, n in enumerate(names) if any(h == a or len(a) > 2 and a in h for a in wanted for h in (plain(n),))]


def category(names: list[str], fields: dict[str, int]) -> tuple[str, float]:
    """The category of a sheet by its headers, and how sure that is."""
    headers = [plain(n) for n in names]
    scores = []
    for kind, words in CATEGORY_WORDS.items():
        score = sum(3 if (p := plain(w)) in headers else any(p in h for h in headers) for w in words)
        score += sum(bonus for k, columns, bonus in CATEGORY_BONUS if k == kind and all(c in fields for c in columns))
        scores.append((score, kind))
    ranked = sorted(scores, key=lambda s: -s[0])
    best, second = ranked[0], ranked[1][0]
    sure = min(1.0, best[0] / max(6, best[0] + second)) if best[0] > 0 else 0.0
    return (best[1], sure) if best[0] >= 3 and sure >= 0.42 else ("Generic", sure)


OVERRIDES = {"Supplier Offer": "Supplier Offers", "Quotation": "RFQ"}


def chosen_category(selected: str, detected: str) -> str:
    """What the user selected, unless it is to be detected."""
    return detected if selected in ("", "Auto Detect") else OVERRIDES.get(selected, selected)
