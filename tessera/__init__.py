"""A PySpark-native engine that treats source trees and text corpora as relations."""
