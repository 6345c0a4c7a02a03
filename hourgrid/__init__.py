"""hourgrid: regional energy and weather hourly series on Spark DataFrames.

Layout:
    sources/    landed pages, weather text, driver-table bindings
    functions/  scalar Column expressions (text, time, null-safe numbers)
    operators/  DataFrame -> DataFrame operators (reshape, sites, features,
                reports, splits, metrics, model, sinks, ordered windows)
    plans/      composed pipelines, the registered query catalog, oracle SQL
    streaming/  incremental landing of reading pages
"""

__version__ = "0.1.0"
