"""Panel forecasting analytics and training-data operators on Spark."""
