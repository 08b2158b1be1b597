"""Fixed values that must equal the original scoring rules for equal results.

FIXED VALUES -- vocabularies, label lists, patterns, tolerances and answer
templates, kept in their natural order (found terms keep this order).
"""

# FIXED VALUES: unsupported-term vocabulary per scoring profile.
TERMS_SINGLE = [
    "actual", "absolute error", "abs error", "average error", "storm", "front",
    "pressure", "cloud", "rain", "precipitation", "humidity", "cause", "caused",
    "celsius", "meters per second", "°c", "m/s", "km/h", "kilometers per hour",
    "conversion", "converted", "note", "explanation", "additional details",
]

TERMS_V1 = [
    "actual", "observed", "absolute error", "error", "humidity", "precipitation",
    "rain", "snow", "storm", "cloudy", "sunny", "fog", "visibility", "pressure",
    "confidence", "likely", "probably",
]

TERMS_V2 = [
    "actual", "observed", "absolute error", "abs error", "average error", "error",
    "humidity", "precipitation", "rain", "snow", "storm", "cloudy", "cloud",
    "sunny", "fog", "visibility", "pressure", "confidence", "likely", "probably",
    "celsius", "°c", "meters per second", "m/s", "km/h", "kilometers per hour",
    "conversion", "converted", "additional details",
]

# FIXED VALUES: labels searched, in order, for each forecast field.
LABELS = {
    "predicted_temperature": ["predicted temperature", "temperature", "temp"],
    "predicted_dew_point": ["predicted dew point", "dew point", "dewpoint"],
    "predicted_wind_speed": ["predicted wind speed", "wind speed", "wind"],
}

# FIXED VALUES: patterns.  Blanks and digits are those of Unicode.
NUMBER_PATTERN = r"-?\d+(?:\.\d+)?"
DATETIME_PATTERN = r"\d{4}-\d{2}-\d{2}\s+\d{2}:\d{2}:\d{2}"
NEAR_TEMPLATE = r"{label}\s*(?:is|of|:|=)?\s*(-?\d+(?:\.\d+)?)"
FAR_TEMPLATE = r"{label}.*?(-?\d+(?:\.\d+)?)"
# FIXED VALUES: the blanks of Unicode as a character class (Java's \s has the ASCII ones only).
BLANK_CLASS = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# FIXED VALUES: tolerances.
MATCH_TOLERANCE = 0.05      # v2 / single: |expected - observed| <= 0.05
PRESENCE_TOLERANCE = 0.01   # v1: any number within 0.01 of expected

# FIXED VALUES: field names in output order.
FORECAST_FIELDS = [
    "forecast_target_time", "predicted_temperature", "predicted_dew_point", "predicted_wind_speed",
]
REQUIRED_TOOL_FIELDS = [
    "request_time", "forecast_target_time", "predicted_temperature",
    "predicted_dew_point", "predicted_wind_speed",
]
MEASURES = ["temperature", "dew_point", "wind_speed"]

# FIXED VALUES: answer templates.
VERIFIED_V2 = (
    "The forecast target time is {t}. The predicted temperature is {x}°F. "
    "The predicted dew point is {y}°F. The predicted wind speed is {z} mph."
)
REFUSAL_V2 = (
    "I cannot produce a forecast because the verified tool output is missing required fields: {missing}."
)
VERIFIED_V1 = (
    "For the 24-hour forecast target time {t}, the predicted temperature is {x}, "
    "the predicted dew point is {y}, and the predicted wind speed is {z}."
)
REFUSAL_V1 = "I cannot produce a forecast because the tool output is missing required fields: {missing}"
USER_REQUEST = "Give me the weather forecast for 24 hours after {request_time}."
