"""Names, patterns, bands and tables that results must agree with. Every function takes them as a parameter."""

from __future__ import annotations

# Parameter names (lower case) to their display form
NAME_ALIASES = {
    "%z": "Transformer Impedance", "z%": "Transformer Impedance", "impedance": "Transformer Impedance", "impedance %": "Transformer Impedance",
    "impedance percent": "Transformer Impedance", "transformer impedance": "Transformer Impedance", "transformer impedance %": "Transformer Impedance",
    "transformer impedance percent": "Transformer Impedance", "rated impedance": "Transformer Impedance", "per unit impedance": "Transformer Impedance",
    "ifla": "Full Load Amperes", "fla": "Full Load Amperes", "full load amperes": "Full Load Amperes", "full-load amperes": "Full Load Amperes", "full load current": "Full Load Amperes",
    "fault current": "Fault Current", "short-circuit current": "Fault Current", "short circuit current": "Fault Current", "available fault current": "Fault Current",
    "transformer rating": "Transformer Rating", "kva rating": "Transformer Rating", "rated power": "Transformer Rating", "rated capacity": "Transformer Rating",
    "transformer kva": "Transformer Rating", "transformer size": "Transformer Rating",
    "system voltage": "System Voltage", "voltage": "System Voltage", "nominal voltage": "System Voltage", "rated voltage": "System Voltage",
    "fuse designation": "Fuse Designation", "fuse part number": "Fuse Designation", "fuse type": "Fuse Designation", "fuse model": "Fuse Designation",
    "feeder rating": "Feeder Rating", "feeder circuit rating": "Feeder Rating", "feeder current rating": "Feeder Rating", "feeder fuse rating": "Feeder Rating",
    "feeder amp rating": "Feeder Rating", "feeder ampere rating": "Feeder Rating", "feeder size": "Feeder Rating",
    "branch circuit rating": "Branch Circuit Rating", "branch circuit breaker rating": "Branch Circuit Rating", "branch rating": "Branch Circuit Rating",
    "breaker rating": "Branch Circuit Rating", "circuit breaker rating": "Branch Circuit Rating", "branch breaker rating": "Branch Circuit Rating",
    "inrush duration": "Inrush Duration", "inrush point duration": "Inrush Duration", "inrush multiplier": "Inrush Multiplier", "inrush point multiplier": "Inrush Multiplier",
    "inrush locked amperes": "Inrush Current", "inrush current": "Inrush Current",
    "conductor size": "Conductor Size", "cable size": "Conductor Size", "wire size": "Conductor Size", "conductor type": "Conductor Type", "cable type": "Conductor Type", "wire type": "Conductor Type",
    "current rating": "Current Rating", "amp rating": "Current Rating", "ampere rating": "Current Rating",
}

# Names (case matters) to the phrase that is embedded
PHRASES = {
    "%Z": "transformer impedance percent", "%z": "transformer impedance percent", "Z%": "transformer impedance percent", "Impedance": "transformer impedance percent",
    "Rated Impedance": "transformer impedance percent", "Per Unit Impedance": "transformer impedance percent", "Transformer Impedance": "transformer impedance percent",
    "Transformer Rating": "transformer rated apparent power kVA", "Rated Power": "transformer rated apparent power kVA", "Rated Capacity": "transformer rated apparent power kVA",
    "kVA Rating": "transformer rated apparent power kVA",
    "System Voltage": "system voltage kV", "Primary Voltage": "transformer primary voltage kV", "HV Voltage": "transformer primary voltage kV",
    "Secondary Voltage": "transformer secondary voltage V", "LV Voltage": "transformer secondary voltage V",
    "BIL": "basic insulation level dielectric withstand", "Basic Insulation Level": "basic insulation level dielectric withstand",
    "Fault Current": "short circuit fault current", "Short Circuit Current": "short circuit fault current", "IFLA": "full load amperes IFLA", "Full Load Amperes": "full load amperes IFLA",
}

# Phrase to tolerance family
FAMILIES = {
    "transformer impedance percent": "impedance_pct", "transformer rated apparent power kVA": "rated_power_kva", "transformer primary voltage kV": "voltage_kv",
    "transformer secondary voltage V": "voltage_kv", "system voltage kV": "voltage_kv", "basic insulation level dielectric withstand": "voltage_kv",
    "short circuit fault current": "fault_current_a", "full load amperes IFLA": "fault_current_a",
}

# Fixed values: (family, tolerance, major, critical) in percent; the last is the default
BANDS = [("impedance_pct", 7.5, 20.0, 50.0), ("rated_power_kva", 5.0, 10.0, 50.0), ("voltage_kv", 0.5, 5.0, 50.0), ("fault_current_a", 5.0, 20.0, 50.0)]
DEFAULT_BAND = (1.0, 10.0, 50.0)
CLASS_BANDS = [("equipment_spec", "impedance_pct", 5.0, 15.0, 40.0), ("equipment_spec", "rated_power_kva", 2.5, 7.5, 30.0), ("relay_setting_sheet", "fault_current_a", 5.0, 15.0, 40.0)]

# Document classes by family, the most authoritative last
HIERARCHY = {
    "transformer_params": ["coordination_study", "relay_setting_sheet", "equipment_spec"],
    "relay_settings": ["coordination_study", "equipment_spec", "relay_setting_sheet"],
}

# Families that depend on a family
COUPLED = {
    "impedance_pct": ["fault_current_a", "fault_current_ka", "relay_pickup_a", "coordination_margin_pct", "voltage_regulation_pct"],
    "transformer_rating_va": ["cable_ampacity_a", "breaker_interrupting_ka", "ct_ratio", "transformer_loading_pct"],
    "voltage_v": ["bil_kv", "surge_arrester_rating_kv", "clearance_mm", "conductor_amp"],
    "voltage_kv": ["bil_kv", "surge_arrester_rating_kv", "clearance_mm", "conductor_amp"],
    "fault_current_a": ["relay_pickup_a", "breaker_interrupting_ka", "ground_grid_size_m2", "arc_flash_cal_cm2"],
    "fault_current_ka": ["relay_pickup_a", "breaker_interrupting_ka", "ground_grid_size_m2", "arc_flash_cal_cm2"],
    "motor_fla_a": ["cable_ampacity_a", "overload_pickup_a", "starting_current_a"],
    "relay_pickup_a": ["coordination_margin_pct", "trip_curve_time_s"],
    "fuse_amps": ["coordination_margin_pct", "trip_curve_time_s", "breaker_interrupting_ka"],
    "breaker_interrupting_ka": ["fault_current_ka", "arc_flash_cal_cm2"],
}

# Fixed values: (pattern with the token in group 1, name, unit or None for a designation), in order
PATTERNS = [
    (r"(\d[\d,]*\.?\d*)\s*%\s*Z\b", "%Z", "%"),
    (r"(?i)Fault\s+\S+\s+(\d[\d,]*\.?\d*)\s*A\s+RMS\s+Sym", "Fault Current", "A"),
    (r"(?i)(\d[\d,]*\.?\d*)\s*K?VA\s+XFMR", "Transformer Rating", "kVA"),
    (r"(?i)(\d[\d,]*\.?\d*)\s*MVA\s+XFMR", "Transformer Rating", "MVA"),
    (r"IFLA\s*=\s*(\d[\d,]*\.?\d*)\s*A\b", "IFLA", "A"),
    (r"^(\d[\d,]*\.?\d*)\s*(?:kV|KV)\b(?!A)", "System Voltage", "kV"),
    (r"\b(LPN-RK-\d+SP)\b", "Fuse Designation", None),
    (r"\b(LPS-RK-\d+SP)\b", "Fuse Designation", None),
    (r"\b(KRP-C-\d+SP)\b", "Fuse Designation", None),
]
LABEL_VALUE = r"^([A-Z][A-Za-z][A-Za-z ]{0,40}?)\s*:\s*(\d[\d,]*\.?\d*)\s*(kVA|MVA|kV|MV|kA|VA|kHz|MHz|Hz|°C|°F|Ω|μF|%|V|A)(?:\s|$|[^A-Za-z0-9])"
ROW_MARKER = r"^[\s|]*([①-⑳]|[㉑-㉟]|\d{1,3}[.)]?|[A-Z][\-]?\d{1,3})\s+"

# Fixed values: (pattern, family, factor to the unit of the range) and the plausible range of each family
PLAUSIBLE_PATTERNS = [
    (r"(\d[\d,]*\.?\d*)\s*%\s*Z\b", "impedance_pct", 1.0),
    (r"(?i)(\d[\d,]*\.?\d*)\s*MVA\b", "rated_power_kva", 1000.0),
    (r"(?i)(\d[\d,]*\.?\d*)\s*K?VA\b", "rated_power_kva", 1.0),
    (r"(\d[\d,]*\.?\d*)\s*(?:kV|KV)\b(?!A)", "voltage_kv", 1.0),
    (r"(?i)Fault\s+\S+\s+(\d[\d,]*\.?\d*)\s*A\s+RMS", "fault_current_a", 1.0),
    (r"IFLA\s*=\s*(\d[\d,]*\.?\d*)\s*A\b", "ifla_a", 1.0),
]
PLAUSIBLE_RANGES = {"impedance_pct": (1.5, 25.0), "rated_power_kva": (1.0, 1_000_000.0), "voltage_kv": (0.1, 1500.0), "fault_current_a": (50.0, 200_000.0), "ifla_a": (0.1, 100_000.0)}

# Fixed values: (pattern, type, id prefix, label with the groups in place), in order
TAG_PATTERNS = [
    (r"(?i)\bMOV-(\d+)\b", "motor_operated_valve", "mov", "MOV-{0}"), (r"(?i)\bXFMR-(\d+)\b", "transformer", "xfmr", "XFMR-{0}"), (r"(?i)\bCB-(\d+)\b", "breaker", "cb", "CB-{0}"),
    (r"(?i)\bLine\s+(\d+[A-Za-z]?)\b", "line", "line", "Line {0}"), (r"\bBus\s+([A-Z])-(\d+)\b", "bus", "", "Bus {0}-{1}"), (r"(?i)\bRelay\s+([A-Z])-(\d+)\b", "relay", "", "Relay {0}-{1}"),
    (r"\bT-(\d+)\b", "transformer", "t", "T-{0}"), (r"\bP-(\d+)\b", "pump", "p", "P-{0}"), (r"\bM-(\d+)\b", "motor", "m", "M-{0}"), (r"\bV-(\d+)\b", "valve", "v", "V-{0}"), (r"\bR-(\d+)\b", "relay", "r", "R-{0}"),
]
ENTITY_TYPES = ["transformer", "breaker", "relay", "line", "bus", "motor", "pump", "valve", "motor_operated_valve", "implicit"]

# Slugs of context titles to their handle
CONTEXT_ALIASES = {
    "tcc1": "tcc1", "tcc2": "tcc2", "tcc3": "tcc3", "coordinationcurve1": "tcc1", "coordinationcurve2": "tcc2", "coordinationcurve3": "tcc3",
    "coordinationplot1": "tcc1", "coordinationplot2": "tcc2", "coordinationplot3": "tcc3", "timecurrentcurve1": "tcc1", "timecurrentcurve2": "tcc2", "timecurrentcurve3": "tcc3",
    "timecurrentcurve1tcc1": "tcc1", "timecurrentcurve2tcc2": "tcc2", "timecurrentcurve3tcc3": "tcc3", "transformerinrush1": "tcc1", "transformerinrush2": "tcc2", "transformerinrush3": "tcc3",
    "oneline": "one_line", "one_line": "one_line", "singleline": "one_line", "single_line": "one_line", "onelinediagram": "one_line",
    "schedule": "schedule", "transformerschedule": "transformer_schedule", "fuseschedule": "fuse_schedule",
}
CONTEXT_SERIES = r"^(?:tcc|coordinationcurve|coordinationplot|timecurrentcurve|transformerinrush)\s*(\d+)$"

# Shapes of identity labels, in order, and words that tell the kind of equipment, in order
ANCHORS = [r"\b(?:LPS|LPN|LPJ|KRP|FNQ|FRS|FRN)-[A-Z]+-\d+[A-Z]+\b", r"\b(?:JCN|JJN|JJS|EC|KTK)\s*[\-]?\s*\d+[A-Z]*\b", r"\b(?:XFMR|TX|T)\s*[\-]?\s*[A-Z]?\d+[A-Z]?\b"]
KIND_WORDS = [
    ("transformer", ["xfmr", "transformer", "kva ", "mva "]), ("fuse", ["fuse", "lps-rk", "lpn-rk", "krp-c", "jcn ", "lpj-", "jjn-", "frs-"]),
    ("breaker", ["breaker", "circuit breaker", "mccb", " cb ", "20a cb"]), ("relay", ["relay", "overload relay", "mv olr", "overcurrent relay"]),
    ("cable", ["conductor", "cable", "thw", "xlp", "kcmil", "awg"]),
]
