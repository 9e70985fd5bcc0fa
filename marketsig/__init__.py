"""marketsig: market-signal analytics written as Spark DataFrame plans.

Every public function takes DataFrames (or column expressions) and returns a
lazy DataFrame; nothing is collected to the driver.  The same plan serves ten
tickers or ten million.
"""

__version__ = "0.1.0"
