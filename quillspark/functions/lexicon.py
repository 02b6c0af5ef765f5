"""Default lexicons. Terms and their order decide results; every operator takes its own instead."""

from pathlib import Path

SECTION_ALIASES = {
    "abstract": ["abstract"],
    "introduction": ["introduction", "background"],
    "methods": ["method", "methods", "methodology", "experimental", "experiment", "materials and methods", "model", "simulation", "computational methods"],
    "results": ["result", "results", "findings"],
    "discussion": ["discussion"],
    "conclusion": ["conclusion", "conclusions", "summary", "outlook", "future work"],
    "references": ["references", "bibliography"],
}
ROLES = {
    "main_focus": ["we study", "we investigate", "we report", "we present", "we propose", "this work", "this paper", "aim", "focus"],
    "materials_system": ["compound", "thin film", "heterostructure", "semiconductor", "ferroelectric", "oxide", "chalcogenide", "wafer", "alloy", "ceramic", "composite", "perovskite", "graphene", "nanoparticle", "nanowire"],
    "method": ["prepared", "fabricated", "synthesized", "deposited", "measured", "characterized", "simulated", "calculated", "using", "method", "model", "experiment"],
    "result": ["show", "shows", "demonstrate", "demonstrates", "found", "observed", "revealed", "result", "increase", "decrease", "improvement", "enhanced", "suppressed"],
    "limitation": ["however", "limitation", "limited", "challenge", "future work", "requires", "uncertain", "remain", "further"],
}
ROLE_SECTIONS = {
    "main_focus": ["abstract", "introduction", "body"],
    "materials_system": ["abstract", "methods", "introduction", "body"],
    "method": ["methods", "abstract", "body"],
    "result": ["results", "discussion", "conclusion", "abstract", "body"],
    "limitation": ["conclusion", "discussion", "results", "body"],
}
SECTION_WEIGHTS = {"abstract": 1.45, "conclusion": 1.35, "results": 1.22, "discussion": 1.15, "methods": 1.05, "introduction": 1.0, "body": 0.95}
DOMAIN = {
    "materials_system": ["film", "thin film", "heterostructure", "ferroelectric", "semiconductor", "skyrmion", "vdw", "van der waals", "oxide", "chalcogenide", "silicon", "wafer"],
    "fabrication_or_synthesis": ["synthesis", "growth", "deposition", "annealing", "lithography", "etching", "sputtering", "cvd", "mocvd", "ald", "exfoliation"],
    "characterization": ["sem", "tem", "fib", "xrd", "x-ray diffraction", "x ray diffraction", "raman", "afm", "ebsd", "shg", "ellipsometry", "metrology", "microscopy", "spectroscopy", "characteriz", "diffract"],
    "results_or_performance": ["increase", "decrease", "improvement", "mobility", "coercive", "polarization", "switching", "stability", "efficiency", "accuracy", "defect density"],
    "limitations_or_future_work": ["limitation", "challenge", "future work", "however", "requires", "uncertain", "noise", "artifact", "scalability"],
}
QUESTION_TYPES = {
    "materials_system": ["material", "materials", "system", "sample", "compound", "film", "structure", "what is studied", "材料", "体系", "样品", "研究对象", "研究了什么"],
    "method": ["method", "methods", "approach", "prepared", "fabricated", "synthesized", "characterized", "measured", "simulated", "calculated", "how", "方法", "怎么做", "如何", "制备", "表征", "测量", "模拟", "计算"],
    "result": ["result", "results", "finding", "findings", "performance", "show", "shows", "demonstrate", "conclusion", "结果", "发现", "性能", "说明", "证明", "结论"],
    "limitation": ["limitation", "limitations", "challenge", "challenges", "problem", "future work", "drawback", "weakness", "限制", "局限", "问题", "挑战", "不足", "未来"],
    "parameter": ["parameter", "parameters", "temperature", "field", "current", "voltage", "thickness", "size", "dimension", "frequency", "value", "参数", "设定", "温度", "电流", "电压", "厚度", "尺寸", "数值", "磁场"],
}
#: Words of high document frequency in prose corpora without scientific vocabulary, for corpus-wide runs.
COMMON = {"relation": ["with", "from", "by"], "state": ["was", "are"], "pointer": ["this", "that", "this work"]}


def stop_words(path: str | None = None) -> list[str]:
    """The words of a stop list file; without a path, the English list that vectorizers commonly use."""
    return (Path(path) if path else Path(__file__).with_name("stop_words.txt")).read_text().split()


STOP_WORDS = stop_words()
# Fixed values of answers and comparisons.
QUERY_EXPANSION = {
    "materials_system": ["material", "sample", "compound", "thin film", "heterostructure", "semiconductor", "ferroelectric", "oxide", "chalcogenide", "wafer"],
    "method": [
        "method", "fabrication", "synthesis", "deposition", "annealing", "lithography", "etching", "characterization", "measurement", "simulation", "calculation",
        "SEM", "scanning electron microscopy", "TEM", "transmission electron microscopy", "XRD", "X-ray diffraction", "Raman", "AFM", "atomic force microscopy",
    ],
    "result": ["result", "show", "demonstrate", "observe", "increase", "decrease", "improve", "enhance", "performance", "stability", "efficiency", "switching"],
    "limitation": ["limitation", "challenge", "however", "future work", "requires", "uncertain", "noise", "artifact", "scalability"],
    "parameter": ["parameter", "temperature", "current", "voltage", "field", "thickness", "size", "dimension", "frequency", "value", "rate", "time"],
    "general": ["study", "paper", "work", "method", "result", "material", "performance"],
}
ANSWER_TERMS = {
    "materials_system": DOMAIN["materials_system"],
    "method": DOMAIN["fabrication_or_synthesis"] + DOMAIN["characterization"],
    "result": DOMAIN["results_or_performance"],
    "limitation": DOMAIN["limitations_or_future_work"],
    "parameter": ["temperature", "current", "voltage", "field", "thickness", "size", "dimension", "frequency", "parameter", "value", "rate", "time"],
    "general": [],
}
CLAIMS = ["we show", "we demonstrate", "we find", "we observe", "the results", "this suggests", "indicating that", "therefore", "however"]
DIMENSIONS = {
    "Research focus": ["we study", "we investigate", "we report", "we present", "we propose", "this work", "this paper", "aim", "focus", "objective", "goal"],
    "Material / system": DOMAIN["materials_system"] + ["sample", "compound", "material system", "device structure", "layered", "hybrid structure"],
    "Fabrication / synthesis": DOMAIN["fabrication_or_synthesis"] + ["prepared", "fabricated", "transferred", "grown", "processed", "patterned"],
    "Characterization / measurement": DOMAIN["characterization"] + ["measurement", "measured", "characterized", "spectroscopy", "diffraction", "imaging", "electrical measurement", "optical measurement"],
    "Parameters / settings": [
        "temperature", "current", "voltage", "field", "magnetic field", "electric field", "thickness", "width", "length", "diameter", "size", "dimension",
        "frequency", "power", "pressure", "time", "rate", "dose", "concentration", "parameter", "setting", "condition",
    ],
    "Key results / performance": DOMAIN["results_or_performance"] + ["show", "shows", "demonstrate", "demonstrates", "observed", "revealed", "achieved", "performance", "response", "signal", "effect"],
    "Limitations / future work": DOMAIN["limitations_or_future_work"] + ["drawback", "weakness", "future direction", "further study", "needs", "need to", "still", "remain"],
}
CONDITIONS = ["under", "at", "with", "using", "condition", "parameter", "set to", "fixed", "varied"]
OUTCOMES = ["show", "shows", "demonstrate", "demonstrates", "indicate", "suggest", "therefore", "as a result"]
UNITS = ["nm", "μm", "um", "mm", "cm", "m", "k", "K", "°C", "c", "T", "mT", "Oe", "A", "mA", "uA", "μA", "V", "mV", "eV", "meV", "Hz", "kHz", "MHz", "GHz", "s", "ms", "ns", "min", "h", "Pa", "bar", "rpm", "%", "wt%", "at%"]
FIGURE_PURPOSES = {
    "structure": ["schematic", "diagram", "示意图"],
    "relationship": ["versus", "comparison", "compare", "dependence", "as a function"],
    "image": ["spectrum", "spectra", "micrograph", "mapping", "map", "image"],
}
