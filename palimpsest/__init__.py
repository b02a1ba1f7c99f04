"""A PySpark-native analytics engine for temporal knowledge graphs and the text behind them."""
