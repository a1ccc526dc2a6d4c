"""Sources and sinks: driver tables, derived report views, CSV/JSON/text IO."""
