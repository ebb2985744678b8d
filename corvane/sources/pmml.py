"""PMML 4.1 documents of fitted models."""

from __future__ import annotations

import xml.etree.ElementTree as ET

from pyspark.sql import DataFrame

_NS = "http://www.dmg.org/PMML-4_1"


def _root(fields: list[tuple[str, str, str, list]]) -> ET.Element:
    root = ET.Element("PMML", version="4.1", xmlns=_NS)
    header = ET.SubElement(root, "Header", copyright="corvane")
    ET.SubElement(header, "Application", name="corvane")
    d = ET.SubElement(root, "DataDictionary", numberOfFields=str(len(fields)))
    for name, op, kind, values in fields:
        f = ET.SubElement(d, "DataField", name=name, optype=op, dataType=kind)
        for v in values:
            ET.SubElement(f, "Value", value=str(v))
    return root


def _schema(model: ET.Element, target: str, features: list[str]) -> None:
    s = ET.SubElement(model, "MiningSchema")
    ET.SubElement(s, "MiningField", name=target, usageType="predicted")
    for f in features:
        ET.SubElement(s, "MiningField", name=f)


def _text(root: ET.Element) -> str:
    ET.indent(root)
    return ET.tostring(root, encoding="unicode", xml_declaration=True)


def _names(k: int, names: list[str] | None) -> tuple[str, list[str]]:
    names = names or ["y", *[f"x{i + 1}" for i in range(k)]]
    if len(names) != k + 1:
        raise ValueError(f"{k + 1} names are needed, the response first")
    return names[0], names[1:]


def regression(model: DataFrame, kind: str = "linear", names: list[str] | None = None) -> str:
    """A linear or logistic regression (kind linear, logistic)."""
    coef = model.first().coef
    target, features = _names(len(coef), names)
    values = ["true", "false"] if kind == "logistic" else []
    root = _root([(target, "categorical" if values else "continuous", "boolean" if values else "double", values), *[(f, "continuous", "double", []) for f in features]])
    attributes = {"functionName": "classification" if values else "regression", "modelName": kind}
    if values:
        attributes["normalizationMethod"] = "softmax"
    m = ET.SubElement(root, "RegressionModel", attributes)
    _schema(m, target, features)
    t = ET.SubElement(m, "RegressionTable", {"intercept": "0"} | ({"targetCategory": "true"} if values else {}))
    for f, c in zip(features, coef):
        ET.SubElement(t, "NumericPredictor", name=f, coefficient=repr(float(c)))
    if values:
        ET.SubElement(m, "RegressionTable", intercept="0", targetCategory="false")
    return _text(root)


_DISTRIBUTION = {"poisson": "poisson", "gaussian": "normal", "gamma": "gamma", "inverse_gaussian": "igauss", "binomial": "binomial"}
_LINK = {"log": ("log", None), "identity": ("identity", None), "sqrt": ("power", "0.5"), "inverse": ("power", "-1"), "sqr_inverse": ("power", "-2"), "logit": ("logit", None), "probit": ("probit", None)}


def _general(root, target, features, attributes, cells):
    m = ET.SubElement(root, "GeneralRegressionModel", attributes)
    _schema(m, target, features)
    p = ET.SubElement(m, "ParameterList")
    for i, f in enumerate(features):
        ET.SubElement(p, "Parameter", name=f"p{i}", label=f)
    ET.SubElement(m, "FactorList")
    c = ET.SubElement(m, "CovariateList")
    for f in features:
        ET.SubElement(c, "Predictor", name=f)
    pp = ET.SubElement(m, "PPMatrix")
    for i, f in enumerate(features):
        ET.SubElement(pp, "PPCell", value="1", predictorName=f, parameterName=f"p{i}")
    pm = ET.SubElement(m, "ParamMatrix")
    for cell in cells:
        ET.SubElement(pm, "PCell", cell)
    return m


def glm(model: DataFrame, family: str, link: str, names: list[str] | None = None) -> str:
    coef = model.first().coef
    target, features = _names(len(coef), names)
    binary = family == "binomial"
    root = _root([(target, "categorical" if binary else "continuous", "boolean" if binary else "double", ["true", "false"] if binary else []), *[(f, "continuous", "double", []) for f in features]])
    function, power = _LINK[link]
    attributes = {"modelType": "generalizedLinear", "functionName": "classification" if binary else "regression", "distribution": _DISTRIBUTION[family], "linkFunction": function}
    if power:
        attributes["linkParameter"] = power
    _general(root, target, features, attributes, [{"parameterName": f"p{i}", "beta": repr(float(c))} | ({"targetCategory": "true"} if binary else {}) for i, c in enumerate(coef)])
    return _text(root)


def multinom(model: DataFrame, names: list[str] | None = None) -> str:
    rows = model.collect()  # a row for each category
    target, features = _names(len(rows[0].coef), names)
    categories = [rows[0].ref_category, *[r.category for r in rows]]
    root = _root([(target, "categorical", "string", categories), *[(f, "continuous", "double", []) for f in features]])
    cells = [{"targetCategory": r.category, "parameterName": f"p{i}", "beta": repr(float(c))} for r in rows for i, c in enumerate(r.coef)]
    _general(root, target, features, {"modelType": "multinomialLogistic", "functionName": "classification", "targetReferenceCategory": categories[0]}, cells)
    return _text(root)


def ordinal(model: DataFrame, cat_order: list, link: str = "logit", names: list[str] | None = None) -> str:
    m = model.first()
    target, features = _names(len(m.coef_feature), names)
    root = _root([(target, "ordinal", "string", cat_order), *[(f, "continuous", "double", []) for f in features]])
    cells = [{"targetCategory": str(c), "parameterName": "intercept", "beta": repr(float(t))} for c, t in zip(cat_order, m.coef_threshold)] + [{"parameterName": f"p{i}", "beta": repr(float(c))} for i, c in enumerate(m.coef_feature)]
    _general(root, target, features, {"modelType": "ordinalMultinomial", "functionName": "classification", "cumulativeLink": link}, cells)
    return _text(root)


def _tree_nodes(parent: ET.Element, t, k: int, predicate) -> None:
    n = t.nodes[k]
    label = str(t.classes[max(range(len(n.stats)), key=n.stats.__getitem__)]) if t.classes is not None else repr(n.stats[1] / max(n.stats[0], 1e-300))
    count = sum(n.stats) if t.classes is not None else n.stats[0]
    node = ET.SubElement(parent, "Node", id=str(k), score=label, recordCount=f"{count:g}")
    predicate(node)
    if t.classes is not None:
        for c, s in zip(t.classes, n.stats):
            ET.SubElement(node, "ScoreDistribution", value=str(c), recordCount=f"{s:g}")
    if n.feature < 0:
        return
    name = t.features[n.feature]

    def test(is_left):
        def add(child):
            if n.threshold is not None:
                ET.SubElement(child, "SimplePredicate", field=name, operator="lessOrEqual" if is_left else "greaterThan", value=repr(n.threshold))
                return
            p = ET.SubElement(child, "SimpleSetPredicate", field=name, booleanOperator="isIn" if is_left else "isNotIn")
            values = [t.bins[n.feature][b] for b in n.left_bins]
            a = ET.SubElement(p, "Array", n=str(len(values)), type="string")
            a.text = " ".join(f'"{v}"' for v in values)

        return add

    _tree_nodes(node, t, n.left, test(True))
    _tree_nodes(node, t, n.right, test(False))


def _tree_model(parent: ET.Element, t, target: str) -> None:
    m = ET.SubElement(parent, "TreeModel", functionName="regression" if t.classes is None else "classification", splitCharacteristic="binarySplit")
    _schema(m, target, t.features)
    _tree_nodes(m, t, 0, lambda node: ET.SubElement(node, "True"))


def _tree_root(t, target: str) -> ET.Element:
    fields = [(target, "continuous" if t.classes is None else "categorical", "double" if t.classes is None else "string", t.classes or [])]
    return _root([*fields, *[(f, "continuous" if c else "categorical", "double" if c else "string", [] if c else b) for f, c, b in zip(t.features, t.continuous, t.bins)]])


def tree(model: DataFrame, target: str = "y") -> str:
    from corvane.operators.trees import Tree

    t = Tree.from_json(model.first().tree)
    root = _tree_root(t, target)
    _tree_model(root, t, target)
    return _text(root)


def forest(model: dict[str, DataFrame], target: str = "y") -> str:
    from corvane.operators.trees import Tree

    trees = [Tree.from_json(r.tree) for r in model["model"].orderBy("sample_id").toLocalIterator()]
    t = trees[0]
    root = _tree_root(t, target)
    m = ET.SubElement(root, "MiningModel", functionName="regression" if t.classes is None else "classification")
    _schema(m, target, t.features)
    s = ET.SubElement(m, "Segmentation", multipleModelMethod="average" if t.classes is None else "majorityVote")
    for i, one in enumerate(trees):
        segment = ET.SubElement(s, "Segment", id=str(i + 1))
        ET.SubElement(segment, "True")
        _tree_model(segment, one, target)
    return _text(root)
