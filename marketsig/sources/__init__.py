"""Sources: landed files and tables read with explicit schemas."""
