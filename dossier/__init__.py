"""dossier: PySpark-native analytics over document collections and the record tables around them."""
