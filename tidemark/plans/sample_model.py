"""A small tabular model with one flaw of each kind, for demonstrations and tests."""

from __future__ import annotations

import json

_M = lambda name, expression, **more: {"name": name, "expression": expression, **more}

MODEL = {
    "name": "Depot",
    "model": {
        "tables": [
            {"name": "Orders", "columns": [
                {"name": "OrderID", "dataType": "int64", "summarizeBy": "sum", "isKey": True}, {"name": "DepotKey", "dataType": "int64"}, {"name": "DayKey", "dataType": "int64", "isHidden": True},
                {"name": "Price", "dataType": "double"}, {"name": "Quantity", "dataType": "int64"}, {"name": "DepotTotal", "expression": "SUMX(FILTER(Orders, Orders[DepotKey] = EARLIER(Orders[DepotKey])), Orders[Price])"},
            ], "measures": [
                _M("Sales", "SUM(Orders[Price])", description="all sales", displayFolder="Core", formatString="#,0"),
                _M("Average Price", "SUM(Orders[Price]) / COUNT(Orders[OrderID])"),
                _M("Mean Price", "SUM(Orders[Price])/COUNT(Orders[OrderID]) // the same logic"),
                _M("Loose", "SUM([Price])", formatString="0"),
                _M("Tied", "Orders[Sales] * 2", description="x"),
                _M("Large", "CALCULATE([Sales], FILTER(Orders, Orders[Quantity] > 10))"),
                _M("Safe", "IFERROR(DIVIDE([Sales], [Large]), 0)", displayFolder="Core"),
                _M("Summed", "SUMX(Orders, Orders[Price])"),
                _M("Outer", "COUNTROWS(FILTER(ALL(Orders[DepotKey]), EARLIER(Orders[Price]) > 1))"),
                _M("Again", "IF(SUM(Orders[Price]) > 0, SUM(Orders[Price]), -SUM(Orders[Price]))"),
                _M("Last Year", "CALCULATE([Sales], SAMEPERIODLASTYEAR(Days[Date]))"),
            ]},
            {"name": "Depots", "columns": [{"name": "DepotKey", "dataType": "int64"}, {"name": "Name", "dataType": "string"}]},
            {"name": "Days", "columns": [{"name": "DayKey", "dataType": "int64"}, {"name": "Date", "dataType": "dateTime"}]},
            {"name": "LocalDateTable_1", "isHidden": True, "columns": [{"name": "Date", "dataType": "dateTime"}]},
        ],
        "relationships": [
            {"name": "r1", "fromTable": "Orders", "fromColumn": "DepotKey", "toTable": "Depots", "toColumn": "DepotKey", "crossFilteringBehavior": "bothDirections"},
            {"name": "r2", "fromTable": "Orders", "fromColumn": "DayKey", "toTable": "Days", "toColumn": "DayKey", "isActive": False},
        ],
    },
}


def sample(spark):
    from ..sources.tabular import frames, parse_tmsl

    return frames(spark, parse_tmsl(json.dumps(MODEL), "Depot"))
